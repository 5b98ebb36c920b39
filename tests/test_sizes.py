"""Requests larger than a test's other ones: more pairs than go at once, batches of several ranges."""

import os
import shutil

from kgloom.llm.minhash_tensor import BITS, _met, _repeated
from kgloom.operators import code, text, traverse, write
from kgloom.plans import queries
from kgloom.sources import inverted, tables
from kgloom.sources.store import build
from pyspark.sql import functions as F


def test_new_entities_of_several_ranges(spark):
    """Nothing of a batch is lost where Spark deals its wide and narrow rows into different ranges (before: 4,000 rows gave fewer)."""
    few = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    try:
        kg = build(spark, [("old", "k", ["x"])], [])
        new = spark.range(4000).select(F.col("id").alias("pos"), F.concat(F.lit("new:"), "id").alias("name"), F.lit("k").alias("type"), F.array(F.sha2(F.col("id").cast("string"), 512), F.lit("y")).alias("observations"))
        out, created = write.create_entities(kg, new)
        rows = created.select("id", "name").collect()
        assert sorted((r["id"], r["name"]) for r in rows) == [(i + 2, f"new:{i}") for i in range(4000)]
        again = write.upsert_entities(out, new.limit(0).unionByName(new.select("pos", "name", F.lit("z").alias("type"), "observations")))
        assert again.entities.filter("type = 'z'").count() == 4000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_more_pairs_than_go_at_once(spark, monkeypatch):
    """Portions give what one run gives (before: an error)."""
    chain = [(f"e{i}", f"e{i + 1}", "l") for i in range(9)]
    kg = build(spark, [(f"e{i}", "k", []) for i in range(10)] + [("lone", "k", [])], chain)
    asked = [(7 * i + j, f"e{i}", f"e{j}") for i in range(4) for j in range(5)] + [(100, "e0", "lone"), (101, "e3", "e3")]
    pairs = spark.createDataFrame(asked, "pair_id long, source string, target string")
    monkeypatch.setattr(traverse, "MAX_PAIRS", 6)
    found = {}
    for r in traverse.find_paths(kg, pairs).collect():
        found.setdefault(r["pair_id"], {})[r["pos"]] = r["name"]
    want = {p: [f"e{k}" for k in (range(int(a[1:]), int(b[1:]) + 1) if a <= b else range(int(a[1:]), int(b[1:]) - 1, -1))] for p, a, b in asked if b != "lone"}
    assert {p: [x[i] for i in sorted(x)] for p, x in found.items()} == want


def test_levels_of_many_pairs_stay_narrow(spark, monkeypatch):
    """A thousand pairs at once, as plain Python finds them: rows of a level have a bound, and none is broadcast by the size of its file."""
    import random

    rng = random.Random(5)
    links = [(i, rng.randrange(60)) for i in range(60) for _ in range(2)] + [(60, 61)]
    near = {i: set() for i in range(63)}
    for a, b in links:
        near[a].add(b), near[b].add(a)
    asked = [(7 * i, rng.randrange(63), rng.randrange(63)) for i in range(1000)]

    def path(a, b):
        dist, level = {b: 0}, [b]
        while level and a not in dist:
            level = [y for x in level for y in near[x] if dist.setdefault(y, dist[x] + 1) == dist[x] + 1 and y != x]
        out = [a]
        while a in dist and out[-1] != b:
            out.append(min(y for y in near[out[-1]] if dist.get(y, -1) == dist[out[-1]] - 1))
        return out if a in dist else None

    plans, real = [], traverse.stored

    def kept(df, name, by=None):
        if name == "level":
            plans.append((len(df.columns), df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")))
        return real(df, name, by)

    monkeypatch.setattr(traverse, "stored", kept)
    kg = build(spark, [(f"e{i}", "k", []) for i in range(63)], [(f"e{a}", f"e{b}", "l") for a, b in links])
    pairs = spark.createDataFrame([(p, f"e{a}", f"e{b}") for p, a, b in asked], "pair_id long, source string, target string")
    found = {}
    for r in traverse.find_paths(kg, pairs).collect():
        found.setdefault(r["pair_id"], {})[r["pos"]] = int(r["name"][1:])
    want = {p: w for p, a, b in asked if (w := path(a, b))}
    assert {p: [x[i] for i in sorted(x)] for p, x in found.items()} == want and len(want) < len(asked)
    # a broadcast has a row for each block of pairs (before: 17 columns, and each table broadcast)
    assert plans and all(n <= 10 and sent <= 1 for n, sent in plans)


def test_blocks_are_gathered_in_their_task():
    """Postings are the words of each text, in the order of their keys (before: gathered by three shuffles of every word)."""
    import pyarrow as pa

    texts = [("body", 9 - i % 5, i, ["w", f"v{i % 3}", "w"][: i % 4]) for i in range(40)] + [("name", 1, 0, ["w"]), ("name", 2, 0, [])]
    want = {}
    for source, entity, idx, words in texts:
        for p, w in enumerate(words):
            want.setdefault((source, w, entity, idx, len(words)), []).append(p)
    columns = zip(*texts, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["source", "entity_id", "idx", "t"])
    found = {}
    for block in inverted._blocks(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])):
        for r in block.to_pylist():
            keys = [(d["entity_id"], d["idx"]) for d in r["docs"]]
            assert keys == sorted(keys) and r["max_tf"] == max(len(d["pos"]) for d in r["docs"]) and r["min_len"] == min(d["len"] for d in r["docs"])
            for d in r["docs"]:
                found[(r["source"], r["term"], d["entity_id"], d["idx"], d["len"])] = d["pos"]
    assert found == want


def test_blocks_have_a_bound_of_texts_and_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(inverted, "BLOCK", 3)
    monkeypatch.setattr(inverted, "WORDS", 10)
    sizes = [1, 1, 1, 1, 30, 0, 4, 4, 4, 0, 0, 0, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(["body"] * len(sizes)), pa.array(range(len(sizes)), pa.int64()), pa.array([0] * len(sizes), pa.int64()), pa.array([["a"] * n for n in sizes])], names=["source", "entity_id", "idx", "t"])
    blocks = list(inverted._blocks(iter([batch])))
    found = [[(d["entity_id"], d["len"]) for r in b.to_pylist() for d in r["docs"]] for b in blocks]
    assert found == [[(0, 1), (1, 1), (2, 1)], [(3, 1), (4, 30)], [(6, 4), (7, 4)], [(8, 4)], []]


def test_files_are_parsed_once(spark):
    """Symbols, edges and the tally take one parse of each file (before: one for each use of what was parsed)."""
    parsed = spark.sparkContext.accumulator(0)

    def counted(f):
        parsed.add(1)
        return f

    files = spark.createDataFrame([(f"src/f{i}.py", f"def f{i}():\n    return f{i + 1}()\n".encode()) for i in range(6)], "file string, content binary")
    found, links, tally = code.code_index(files.select(F.udf(counted, "string")("file").alias("file"), "content"))
    assert sorted(r["type"] for r in links.select("type").collect()) == ["calls"] * 5 + ["defines"] * 6
    assert found.count() == 6 and parsed.value == 6


def test_table_keys_are_not_broadcast(spark):
    """A hundred keys of each class stay out of the driver (before: a broadcast, as Spark sized them like the classes)."""
    classes = spark.createDataFrame([(i, [i % 3, *range(1, 20)]) for i in range(6)], "c long, keys array<long>")
    hits = _repeated(classes, 10)
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 6 * 100 and {r["least"] for r in hits.collect()} == {0, 1, 2}


def test_upserted_rows_are_those_of_the_sql(spark, tmp_path):
    """Parts beyond the SQL's range of ids are upserted and not shown (before: shown)."""
    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "part.parquet":
            shutil.copy(f"/root/testdata/sf0.001/{name}", tmp_path)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000_000)).write.parquet(f"{tmp_path}/part.parquet")
    keys = [r[0] for r in part.select("p_partkey").collect()]
    rows = queries.QUERIES["upsert_entities"](spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in rows) == sorted([f"part:{k}" for k in keys] + [f"new:{k + far}" for k in keys for far in (0, 1_000_000_000)])
    assert {r["entity_type"] for r in rows} == {"upserted"} and all(r["observations"].endswith(" | fresh") for r in rows)


def test_members_of_keys_are_not_broadcast(spark, tmp_path):
    """Images of members stay out of the driver, however small their files are (before: files of 10 MB were sent as rows of hundreds)."""
    rows = spark.range(4000).select((F.col("id") % 7).alias("key"), "id", F.array(*(F.lit(i).cast("long") for i in range(BITS))).alias("bits"))
    rows.select("key", F.col("id").alias("c"), (F.col("id") % 3).alias("g"), F.lit(9).cast("long").alias("n"), "bits").write.parquet(f"{tmp_path}/members")
    met = _met(spark.read.parquet(f"{tmp_path}/members"))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.select("c").distinct().count() == 4000


def test_only_the_tables_a_query_reads_are_laid_out(spark, monkeypatch):
    """Degrees and walks write entities and relations, and what comes later adds to them (before: all texts and vectors too)."""
    written, laid = [], tables.lay_out
    monkeypatch.setattr(tables, "_LAID", {})
    monkeypatch.setattr(tables, "lay_out", lambda kg, path, parts: written.append(list(parts)) or laid(kg, path, parts=parts))
    data = "/root/testdata/sf0.001"
    first = queries.QUERIES["degree_by_type"](spark, data).collect()
    assert written == [["entities", "relations"]] and sum(r["entities"] for r in first) == tables.canonical(spark, data).entities.count()
    whole = tables.laid_out(spark, data)
    assert written == [["entities", "relations"], ["observations", "embeddings"]] and whole.layout is not None
    assert tables.laid_out(spark, data, parts=("relations",)) is whole and len(written) == 2
    assert tables.indexed(spark, data, parts=("entities",)).text is tables.indexed(spark, data).text is not None and len(written) == 2


def test_windows_of_a_long_text_are_found_once(spark):
    """NEAR over a text that has its words thousands of times (before: its windows were found anew for each of them)."""
    rows = spark.createDataFrame([(1, ["a", "b"] * 1500), (2, ["a"] * 30 + ["c"] * 40 + ["b"])], "entity_id long, t array<string>")
    counted = text.scanned(rows, text.parse("NEAR(a b, 2)"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan
    assert [tuple(r) for r in counted.select("entity_id", "tf0", "tf1", "all0", "all1").orderBy("entity_id").collect()] == [(1, 1500, 1500, 1500, 1500), (2, 0, 0, 30, 1)]
