"""Vector search on small stores, and the quantizer's published bounds."""

import numpy as np
import pytest
from kgloom.operators import ivf, turboquant, vector
from kgloom.sources.store import build


def found(df):
    return [r["name"] for r in df.collect()]


class Drawn:
    """Seeded vectors of named entities, and exact answers by NumPy."""

    def __init__(self, spark, seed=4, n=40, dims=6):
        rng = np.random.default_rng(seed)
        self.v = np.round(rng.standard_normal((n, dims)), 3).astype(np.float32).astype(np.float64)
        self.names, self.kinds = [f"v{i:02d}" for i in range(n)], [f"k{i % 3}" for i in range(n)]
        self.kg = build(spark, [(a, t, []) for a, t in zip(self.names, self.kinds, strict=True)], [("v00", "v01", "e"), ("v00", "v01", "f"), ("v02", "v00", "e")], dict(zip(self.names, self.v.tolist(), strict=True)))

    def distances(self, q, metric):
        ip = self.v @ q
        if metric == "ip":
            return np.round(1 - ip, 6)
        if metric == "l2sq":
            return np.round(((self.v - q) ** 2).sum(1), 6)
        return np.round(1 - ip / np.linalg.norm(self.v, axis=1) / np.linalg.norm(q), 6)

    def order(self, q, metric="cos"):
        return np.lexsort((np.arange(len(self.v)), self.distances(np.asarray(q), metric)))


@pytest.fixture(scope="module")
def store(spark):
    return Drawn(spark)


@pytest.mark.parametrize("metric", ["cos", "ip", "l2sq"])
def test_search(store, metric):
    q = store.v[3] + 0.05
    got = vector.search_entities(store.kg, q.tolist(), 7, None, metric).collect()
    order = store.order(np.float32(q).astype(np.float64), metric)
    assert [r["name"] for r in got] == [store.names[i] for i in order[:7]]
    assert found(vector.search_entities(store.kg, q.tolist(), 9, "k1", metric)) == [store.names[i] for i in order[:9] if i % 3 == 1]


def test_examples(store):
    others = lambda q, gone, k: [store.names[i] for i in store.order(q) if i not in gone][:k]
    assert found(vector.search_by_entity(store.kg, "v05", 4)) == others(store.v[5], {5}, 4)
    assert found(vector.search_by_entity(store.kg, "v05", 4, exclude_self=False))[0] == "v05"
    mean = store.v[[1, 2, 2]].mean(0)
    assert found(vector.recommend(store.kg, ["v01", "v02", "v02"], [], 3)) == others(mean, {1, 2}, 3)
    away = store.v[[1, 2]].mean(0) - store.v[9]
    assert found(vector.recommend(store.kg, ["v01", "v02"], ["v09"], 3)) == others(away, {1, 2, 9}, 3)
    for bad in ([], ["nobody"]):
        with pytest.raises(ValueError):
            vector.recommend(store.kg, bad)
    assert vector.graph_cache_stats(store.kg).first()[:] == (40, 2)
    for bad in ([], [float("nan")], ["x"], [0.0] * 5000):
        with pytest.raises(ValueError):
            vector.parse_embedding(bad)


@pytest.mark.parametrize("weight", [1.0, 0.6, 0.2])
def test_mmr(store, weight):
    """Greedy choice over the exact pool, one candidate at a time."""
    q, k, pool = store.v[7], 5, 20
    unit = store.v / np.linalg.norm(store.v, axis=1)[:, None]
    left, chosen = [int(i) for i in store.order(q)[:pool]], []
    while len(chosen) < k:
        value = lambda i: round(weight * float(unit[i] @ q / np.linalg.norm(q)) - (1 - weight) * max([0.0, *(float(unit[i] @ unit[j]) for j in chosen)]), 9)  # noqa: B023, E731
        best = max(left, key=lambda i: (value(i), -left.index(i)))
        left.remove(best)
        chosen.append(best)
    assert found(vector.mmr_search(store.kg, q.tolist(), k, pool, weight)) == [store.names[i] for i in chosen]


def test_upserts(spark, store):
    fresh, n = np.arange(6.0), len(store.v)
    rows = [(0, "v03", fresh.tolist(), ""), (1, "ghost", fresh.tolist(), ""), (2, "v04", [1.0], ""), (3, "v03", (fresh + 1).tolist(), "last")]
    items = spark.createDataFrame(rows, "pos int, name string, embedding array<float>, model string")
    grown, outcome = vector.batch_upsert(store.kg, items, 6)
    assert [r["error"] for r in outcome.orderBy("pos").collect()] == [None, "unknown entity", "wrong dimensions", None]
    assert grown.embeddings.count() == n
    assert vector.get_embedding(grown, "v03").first()[:] == ("v03", 6, "last", (fresh + 1).tolist())
    assert vector.delete_embedding(grown, "v03")[1] and not vector.delete_embedding(grown, "ghost")[1]


def test_batch_equals_single(spark, store):
    q = spark.createDataFrame([(i, store.v[i].tolist()) for i in range(0, 40, 9)], "query_id long, embedding array<float>")
    for metric in ("cos", "ip", "l2sq"):
        got = {(r["query_id"], r["rank"]): r["entity_id"] - 1 for r in vector.knn_batch(store.kg.embeddings, q, 3, metric, block=2).collect()}
        for i in range(0, 40, 9):
            assert [got[i, k] for k in (1, 2, 3)] == store.order(store.v[i], metric)[:3].tolist()


def test_ivf(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(2) * 0.1 + (0 if i < 20 else 100)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id long, embedding array<float>")
    index = ivf.train(df, 2, "l2sq")
    assert all(r["entity_id"] < 20 for r in index.search([0, 0], 3, 1).collect())
    whole = [r[:] for r in index.search([0, 0], 10, 2).collect()]
    assert whole == [r[:] for r in vector.knn(df, [0, 0], 10, "l2sq").collect()]


def test_ivf_many(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6, 8)).repeat(50, 0) * 3 + rng.standard_normal((300, 8)))]
    df = spark.createDataFrame(rows, "entity_id long, embedding array<float>")
    asked = df.filter("entity_id % 20 = 0").withColumnRenamed("entity_id", "query_id")
    index, exact = ivf.train(df, 6, "cos"), {r[:] for r in vector.knn_batch(df, asked, 5, "cos").select("query_id", "entity_id").collect()}
    found = lambda nprobe: {r[:] for r in index.search_many(asked, 5, nprobe, 4).select("query_id", "entity_id").collect()}
    assert found(6) == exact
    assert len(found(3) & exact) >= 0.9 * len(exact)


def test_ivf_changes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(60)]
    frame = lambda part: spark.createDataFrame(part, "entity_id long, embedding array<float>")
    moved, fresh, gone = [(i, rng.standard_normal(3).tolist()) for i in range(5)], [(60 + i, rng.standard_normal(3).tolist()) for i in range(5)], frame(rows[10:20]).select("entity_id")
    index = ivf.train(frame(rows), 4, "l2sq").upsert(frame(moved)).remove(gone).bulk_load(frame(fresh))
    now = frame(moved + rows[5:10] + rows[20:] + fresh)
    assert sorted(r["entity_id"] for r in index.cells.collect()) == [r["entity_id"] for r in now.orderBy("entity_id").collect()]
    query = [0.1, 0.2, 0.3]
    assert [r[:] for r in index.search(query, 20, 4).collect()] == [r[:] for r in vector.knn(now, query, 20, "l2sq").collect()]


@pytest.mark.parametrize("bits,mse", [(1, 0.3634), (2, 0.1175), (3, 0.03454), (4, 0.009497)])
def test_codebook(bits, mse):
    x = np.linspace(-6, 6, 200_001)
    p = np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    c = turboquant.codebook(bits)
    err = np.abs(x[:, None] - c[None, :]).min(1) ** 2
    assert abs(float((err * p).sum() * (x[1] - x[0])) / mse - 1) < 0.01


def test_quantizer():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = turboquant.Quantizer(128, 4)
    packed, size = q.mse_encode(x)
    assert ((q.mse_decode(packed, size) - x) ** 2).sum(1).mean() < 1.25 * 0.009497
    code = q.encode(x)
    est = np.stack([q.products(*code, y) for y in x[:20]])
    err = (est - x[:20] @ x.T) ** 2
    assert err.mean() < 1.4 * 0.047 / 128
    assert code[0].shape[1] == 128 * 3 // 8 + 128 // 8
    assert (est.argmax(1) == np.arange(20)).all()
    with pytest.raises(ValueError):
        turboquant.store_quantizer(64)
    assert turboquant.unpack_bits(turboquant.pack_bits(np.arange(8)[None, :], 3), 8, 3).tolist() == [list(range(8))]
