"""Vector indexes: recall against brute force, changes, and searches that go through the one chosen."""

import numpy as np
import pytest
from kgloom.operators import blocks, hnsw, ivf, turboquant, vector
from kgloom.plans.dispatch import Session
from kgloom.sources.store import build, lay_out
from pyspark.sql import functions as F

ROWS = "entity_id long, embedding array<float>"


@pytest.fixture(scope="module")
def drawn(spark):
    """Vectors around some centres; every twentieth is a query."""
    rng = np.random.default_rng(9)
    v = (rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS).repartition(5).cache()
    asked = df.filter("entity_id % 20 = 0").withColumnRenamed("entity_id", "query_id")
    return v.astype(np.float64), df, asked


def brute(v, ids, asked, k, metric):
    d = np.round(blocks.matrix_distance(v[asked], v[ids], metric), 6)
    return {(int(q), int(ids[j])) for q, row in zip(asked, d, strict=True) for j in np.lexsort((ids, row))[:k]}


def share(found, want):
    return len({(r["query_id"], r["entity_id"]) for r in found.collect()} & want) / len(want)


@pytest.mark.parametrize("metric", ["cos", "l2sq", "ip"])
def test_blocks_equal_brute_force(drawn, metric):
    v, df, asked = drawn
    want = brute(v, np.arange(3000), np.arange(0, 3000, 20), 7, metric)
    got = vector.knn_batch(df, asked, 7, metric, block=100)
    assert {(r["query_id"], r["entity_id"]) for r in got.collect()} == want and got.filter("rank = 7").count() == 150
    assert vector.knn_batch(df, asked.limit(0), 7).count() == 0 and vector.knn_batch(df.limit(0), asked, 7).count() == 0


@pytest.mark.parametrize("metric", ["cos", "l2sq"])
def test_small_world(spark, drawn, metric):
    v, df, asked = drawn
    want = brute(v, np.arange(3000), np.arange(0, 3000, 20), 10, metric)
    index = hnsw.train(df, metric, most=1000)
    assert index.shards.count() >= 3 and share(index.search_many(asked, 10), want) >= 0.9
    one = [r[:] for r in index.search(v[40].tolist(), 5).collect()]
    assert one[0][0] == 40 and one == sorted(one, key=lambda r: (r[1], r[0]))
    # removed and replaced vectors: marks, and shards of their own
    gone = df.filter("entity_id % 7 = 3").select("entity_id")
    moved = spark.createDataFrame([(i, (v[i] + 3).tolist()) for i in range(5, 3000, 700)] + [(9000 + i, v[i].tolist()) for i in range(60)], ROWS)
    changed = index.remove(gone).upsert(moved)
    w = np.concatenate([v, np.full((6000, 16), 1e6), v[:60]])
    w[5:3000:700] += 3
    ids = np.array([i for i in [*range(3000), *range(9000, 9060)] if i % 7 != 3 or i >= 9000 or i in range(5, 3000, 700)])
    now = brute(w, ids, np.arange(0, 3000, 20), 10, metric)
    found = changed.search_many(asked, 10)
    assert share(found, now) >= 0.9 and not found.join(gone.join(moved, "entity_id", "left_anti"), "entity_id").count()


def test_every_node_of_a_world_is_linked(drawn):
    v, _, _ = drawn
    graph = hnsw.build(np.arange(500), v[:500], "cos")
    world = hnsw.World(np.arange(500), v[:500], graph, "cos")
    row, offsets, near = world.levels[0]
    assert (np.diff(offsets) <= 2 * hnsw.LINKS).all() and (np.diff(offsets) > 0).all() and len(world.levels) > 1
    assert [j for _, j in world.search(v[17], 20)][0] == 17


def test_codes(drawn):
    v, df, asked = drawn
    want = brute(v, np.arange(3000), np.arange(0, 3000, 20), 10, "cos")
    index = turboquant.code_index(df, turboquant.Quantizer(16, 6), "cos")
    assert share(index.search_many(asked, 10), want) >= 0.9
    plan = index.search(v[3].tolist(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # codes are read, not made; the exact stage reads the best vectors
    got = index.remove(df.filter("entity_id = 3").select("entity_id")).search(v[3].tolist(), 5)
    assert 3 not in [r["entity_id"] for r in got.collect()]


def test_codes_estimate_as_decoded():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((50, 24)), rng.standard_normal((6, 24))
    t = turboquant.Quantizer(24, 4)
    code = t.encode(x)
    assert np.allclose(t.products_many(*code, q), np.stack([t.products(*code, y) for y in q])) and np.allclose(t.products_many(*code, q), q @ t.decode(*code).T)


def test_cells_are_read_alone(drawn, tmp_path):
    v, df, asked = drawn
    index = ivf.train(df, 32, "cos").save(str(tmp_path / "cells"))
    want = brute(v, np.arange(3000), np.arange(0, 3000, 20), 10, "cos")
    assert share(index.search_many(asked, 10, 12), want) >= 0.9 and share(index.search_many(asked, 10, 32), want) == 1.0
    plan = index.search(v[0].tolist(), 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("PartitionFilters: [")[1].startswith("cell#") or "cell#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


@pytest.mark.parametrize("kind", ["hnsw", "ivf", "turboquant"])
def test_searches_go_through_the_index(spark, drawn, tmp_path, kind):
    v, _, _ = drawn
    names = [f"n{i}" for i in range(400)]
    kg = lay_out(build(spark, [(n, "t", []) for n in names], [], dict(zip(names, v[:400].tolist(), strict=True))), str(tmp_path / "kg"))
    s = Session(kg, index_kind=kind)
    assert s.call("vector_store_stats").first()["index_kind"] == "exact"
    assert s.call("vector_reindex").first()[:] == (True, kind, 400) and s.call("vector_store_stats").first()["index_kind"] == kind
    exact = [r["name"] for r in vector.search_entities(kg, v[11].tolist(), 10).collect()]
    found = [r["name"] for r in s.call("vector_search_entities", {"embedding": v[11].tolist(), "topK": 10}).collect()]
    assert found[0] == "n11" and len(set(found) & set(exact)) >= 8
    assert [r["name"] for r in s.call("vector_search_by_entity", {"entityName": "n11", "topK": 3}).collect()] == [n for n in found if n != "n11"][:3]
    # changes reach the index
    s.call("vector_upsert_embedding", {"entityName": "n11", "embedding": (-v[11]).tolist()})
    assert s.call("vector_search_entities", {"embedding": (-v[11]).tolist(), "topK": 1}).first()["name"] == "n11"
    assert s.call("vector_search_entities", {"embedding": v[11].tolist(), "topK": 1}).first()["name"] != "n11"
    assert s.call("vector_delete_embedding", {"entityName": "n11"}) and s.call("vector_search_entities", {"embedding": (-v[11]).tolist(), "topK": 1}).first()["name"] != "n11"
    if kind == "ivf":
        plan = vector.nearest(s.kg, v[0].tolist(), 5, "cos")._jdf.queryExecution().executedPlan().toString()
        assert "cell#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_recall(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "query_id long, entity_id long")
    got = blocks.recall(pairs([(1, 2), (1, 9)]), pairs([(1, 2), (1, 3), (2, 5), (2, 6)])).first()
    assert (got["queries"], got["recall"]) == (2, 0.25)


def test_null_vectors_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], ROWS)
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<float>")
    for found in (vector.knn_batch(df, asked, 5), hnsw.train(df).search_many(asked, 5), turboquant.code_index(df, turboquant.Quantizer(2, 4)).search_many(asked, 5)):
        assert [r["entity_id"] for r in found.orderBy("rank").collect()] == [1, 3]
    assert df.filter(F.col("embedding").isNull()).count() == 1


def test_shards_grow_with_the_table(spark):
    """Twice the vectors are in as many shards, of which each is asked, and a shard that is grown by searches finds what brute force does."""
    v = np.random.default_rng(5).standard_normal((6000, 16)).astype(np.float32).astype(np.float64)
    world = hnsw.World(np.arange(6000), v, hnsw.build(np.arange(6000), v, "l2sq"), "l2sq")
    place, _ = world.search_many(v[::20], 96)
    want = brute(v, np.arange(6000), np.arange(0, 6000, 20), 10, "l2sq")
    assert len({(i * 20, int(j)) for i, own in enumerate(place[:, :10]) for j in own} & want) / len(want) >= 0.9
    few = spark.range(33_000).select(F.col("id").alias("entity_id"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    more = few.unionByName(few.withColumn("entity_id", F.col("entity_id") + 33_000))
    assert hnsw.train(few, "l2sq", 4, 8).shards.count() == hnsw.train(more, "l2sq", 4, 8).shards.count() == 16
