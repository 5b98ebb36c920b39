"""The stored text index and the written layout: what a search reads, and changes."""

import random

import pytest
from kgloom.functions.text import tokens_of
from kgloom.operators import read, text
from kgloom.sources.inverted import BODY, NAME, bucket_of, build_text_index, texts_of
from kgloom.sources.store import build, lay_out
from pyspark.sql import functions as F

KEYS = "source string, entity_id long, idx long"


def _graph(spark, seed, n=60):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdé')}{rng.choice('xyz')}{i}" for i in range(30)]
    return build(spark, [(f"n{i}", "t", [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 3))]) for i in range(n)]), words


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    kg, words = _graph(spark, 3)
    path = str(tmp_path_factory.mktemp("laid"))
    out = lay_out(kg, path, 3)
    return kg, out.with_(text=build_text_index(out, f"{path}/text")), words


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())  # each row has its rank


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def queries(words):
    a, b, c = words[:3]
    return [a, f"{a} {b}", f"{a} OR {c}", f'"{a} {b}"', f"{a[:2]}*", f"{a[0]}*", f"({a} OR {b}) NOT {c}", f"NEAR({a} {b}, 4)", f"n1 OR {c}", "n*", f"^{a}", "missing"]


def test_same_rows_as_a_scan(laid):
    kg, indexed, words = laid
    for q in queries(words):
        for kind, offset, limit in ((None, 0, 20), ("t", 2, 5))[: 1 + (" " in q)]:
            assert rows(text.search_nodes(indexed, q, kind, offset, limit)) == rows(text.search_nodes(kg, q, kind, offset, limit)), q
    assert rows(text.ui_search(indexed, words[0], 5).orderBy("rank")) == rows(text.ui_search(kg, words[0], 5).orderBy("rank"))


def test_a_search_reads_its_words_alone(laid):
    """Partitions of the words' buckets, and a filter on the term that reaches the scan; nothing is tokenised."""
    _, indexed, words = laid
    a, b = (tokens_of(w)[0] for w in words[:2])
    shown = plan(text.looked_up(indexed.text, BODY, text.parse(f"{a} {b}", BODY)))
    buckets = sorted({bucket_of(a), bucket_of(b)})
    assert "PartitionFilters" in shown and "bucket#" in shown.split("PartitionFilters")[1].split("]")[0]
    assert all(str(x) in shown.split("PartitionFilters")[1].split("PushedFilters")[0] for x in buckets)
    assert f"In(term, [{','.join(sorted((a, b)))}])" in shown and "regexp_extract_all" not in shown
    assert f"StringStartsWith(term,{a[:2]})" in plan(text.looked_up(indexed.text, BODY, text.parse(f"{a[:2]}*", BODY)))


def test_changes(spark, laid):
    """Inserts, deletes and a merge give what an index built anew gives."""
    kg, indexed, words = laid
    index = indexed.text
    new = spark.createDataFrame([(900, 0, f"{words[0]} {words[1]} fresh"), (900, 1, "fresh"), (5, 9, f"{words[2]} fresh")], "entity_id long, idx long, body string")
    names = spark.createDataFrame([(900, "n900 fresh", "t")], "id long, name string, type string")
    rows_of = lambda df: df.select(F.lit(BODY).alias("source"), "entity_id", "idx", F.col("body").alias("text"))
    index = index.insert(rows_of(new).unionByName(names.select(F.lit(NAME).alias("source"), F.col("id").alias("entity_id"), F.lit(0).cast("long").alias("idx"), F.col("name").alias("text"))))
    gone = [(BODY, r["entity_id"], r["idx"]) for r in kg.observations.collect() if r["entity_id"] % 7 == 0]
    index = index.delete(spark.createDataFrame(gone, KEYS)).delete_entities(spark.createDataFrame([(11,), (12,)], "id long"))
    left = lambda df, key: df.filter(~F.col(key).isin(11, 12))
    now = kg.with_(
        entities=left(kg.entities.unionByName(names), "id"),
        observations=left(kg.observations.unionByName(new), "entity_id").filter((F.col("entity_id") % 7 != 0) | (F.col("entity_id") == 900)),
    )
    # a text that was deleted and comes again
    again = rows_of(kg.observations.filter("entity_id = 7"))
    index, now = index.insert(again), now.with_(observations=now.observations.unionByName(kg.observations.filter("entity_id = 7")))
    for changed in (index, index.merged()):
        assert len(changed.segments) in (1, 3)
        for source, expected in ((NAME, now.entities.count()), (BODY, now.observations.count())):
            assert changed.totals(source)[0] == expected
        for q in [*queries(words)[:8:2], "fresh", "n900"]:
            assert rows(text.search_nodes(now.with_(text=changed), q)) == rows(text.search_nodes(now, q)), q


def test_changed_graphs_lose_their_index(spark, laid):
    _, indexed, _ = laid
    assert indexed.with_(relations=indexed.relations).text is indexed.text
    assert indexed.with_(entities=indexed.entities).text is None and indexed.with_(observations=indexed.observations).layout is None


def test_lookups_reach_the_scan(laid):
    _, indexed, _ = laid
    assert "EqualTo(name,n7)" in plan(indexed.entities.filter("name = 'n7'")) and "In(name, [n7" in plan(indexed.entities.filter(F.col("name").isin("n7", "n8")))
    (ident,) = indexed.chosen(["n7"])[1]
    shown = plan(read.get_entity(indexed, "n7"))
    assert f"EqualTo(entity_id,{ident})" in shown or f"In(entity_id, [{ident}])" in shown
    for df, end in ((indexed.leaving([ident]), "from_id"), (indexed.entering([ident]), "to_id")):
        assert f"EqualTo({end},{ident})" in plan(df) or f"In({end}, [{ident}])" in plan(df)


def test_texts_without_tokens(spark, tmp_path):
    kg = build(spark, [("a", "t", ["", "--", "x"]), ("", "t", []), ("b", "t", ["x x"])])
    index = build_text_index(kg, str(tmp_path))
    assert index.totals(BODY) == (4, 3) and index.totals(NAME) == (3, 2) and texts_of(kg).count() == 7
    assert rows(text.search_nodes(kg.with_(text=index), "x")) == rows(text.search_nodes(kg, "x"))
