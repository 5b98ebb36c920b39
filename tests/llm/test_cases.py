"""Cases that every operator defines: clashing columns, nulls, empty tables, long texts; and bounds that must hold."""

import random

import corpus_pipeline
import numpy as np
import pytest
from kgloom.llm import fm_quality, minhash_tensor, mix_flow, repair_tokens, secret_forest, substring_chains, surrogates, toxicity_chain, winnow
from kgloom.llm import exact_dedup as exact_dedup_module
from kgloom.llm.exact_dedup import exact_dedup
from kgloom.llm.queries import CATEGORIES
from pyspark.sql import functions as F

from .test_operators import DOCS, brute_groups, labelled

#: Names that operators use inside.
CLASH = """runs buckets mix_size mix_pattern mix_own mix_o mix_runs mix_buckets mix_copy k0 k1 k2 near_key_0 near_id near_null near_text odd_id odd_null odd_text odd_kept kept
 size pattern place taken went bucket text_hash component_id class_id row position word mask maybe part key at t first n spans again kind form draw y words fold p0 p_toxic score label quality toxic
 item_id items n_words keys bits cid c g a b root blob seq start""".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, repeated rows, one long text, and a column of each name in CLASH."""
    docs, labels = labelled(spark, 40)
    rows = [tuple(r) for r in docs.collect()]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None), (100, None, "en", "s", 1), (101, "", "en", "t", 1), (102, "long " * 60_000 + "end", "fr", "t", 1)]
    wide = spark.createDataFrame(rows, DOCS)
    return wide.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in wide.columns)), labels, rows


def test_clashing_columns(spark, odd):
    docs, labels, rows = odd
    items = spark.createDataFrame([(1, " ".join(rows[8][1].split()[5:25]), 7)], "item_id long, text string, doc_id long")
    plain, n = docs.select(*DOCS.replace(",", "").split()[::2]), len(rows)
    chain, model = toxicity_chain.fit_chain(docs, labels, CATEGORIES), fm_quality.fit_quality(docs, labels)
    runs = {
        "mix": lambda d: mix_flow.mix_sources(d, F.array("source")), "exact": exact_dedup, "near": minhash_tensor.near_duplicates, "leaks": lambda d: winnow.decontaminate(d, items),
        "toxic": lambda d: toxicity_chain.score_chain(d, chain), "quality": lambda d: fm_quality.score_quality(d, model), "pii": lambda d: surrogates.replace_pii(d, b"k"),
    }
    for name, run in runs.items():
        assert run(docs).count() == n == run(plain).count(), name
        assert run(docs.limit(0)).count() == 0, name
    for name, run in (("secrets", lambda d: secret_forest.scan_secrets(d, secret_forest.fit_secrets(secret_forest.example_findings(200)))), ("passages", substring_chains.shared_passages)):
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(plain).collect())), name
        assert run(docs.limit(0)).count() == 0, name
    for run in (lambda d: mix_flow.mixed(d, F.array("source")), minhash_tensor.drop_near_duplicates, lambda d: toxicity_chain.drop_toxic(d, chain), lambda d: winnow.drop_contaminated(d, items)):
        got = run(docs)
        assert got.columns == docs.columns and got.count() == run(plain).count() and run(docs.limit(0)).count() == 0


def test_stages_with_clashes(spark, odd, tmp_path):
    docs, labels, rows = odd
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[8][1].split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_chain_uses_earlier_categories(spark):
    """The mark depends on an earlier category whose words the later model rarely saw: its probability moves with that category."""
    rng = random.Random(3)
    marks = [f"mark{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
    rows, labels = [], []
    for i in range(1500):
        general, toxic = i % 3 == 0, i % 3 == 0 and i % 4 != 1
        w = [f"c{rng.randrange(50)}" for _ in range(12)]
        if general:
            w[2], w[7] = rng.choice(marks), rng.choice(marks)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(general), int(toxic)))
    docs, marked = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, general int, toxic int")
    held = F.col("doc_id") % 5 == 0
    chain = toxicity_chain.fit_chain(docs, marked.filter(~held), ("general", "toxic"))
    assert chain.earlier[1][0] > 0.05
    truth = {i: t for i, _, t in labels if i % 5 == 0}
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity_chain.score_chain(docs.filter(held), chain).collect()}
    assert np.mean([got[i] >= 0.5 for i, t in truth.items() if t]) >= 0.9
    chain.earlier[1][:] = 0
    without = {r["doc_id"]: r["p_toxic"] for r in toxicity_chain.score_chain(docs.filter(held), chain).collect()}
    assert np.mean([abs(without[i] - got[i]) > 0.01 for i, t in truth.items() if t]) > 0.5


def test_weak_labels(spark):
    docs = spark.createDataFrame([(i, f"you {'idiot' if i % 2 else 'nice'} w{i % 9} person", "en", "s", 1) for i in range(200)], DOCS)
    chain = toxicity_chain.fit_chain(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"), CATEGORIES)
    got = toxicity_chain.score_chain(docs, chain).collect()
    assert chain.names == list(CATEGORIES) and all((r["p_insult"] >= 0.5) == (r["doc_id"] % 2 == 1) == (r["p_toxic"] >= 0.5) for r in got)


def test_loose_group(spark):
    """Many texts that are all nearly, but not quite, similar, and some that are: equal to brute force."""
    rng, rows = random.Random(1), []
    for i in range(90):
        w = [f"b{j}" for j in range(100)]
        for p in rng.sample(range(100), 1 if i % 9 == 0 else 2):
            w[p] = f"v{i}_{p}"
        rows.append((i, " ".join(w), "en", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    minhash_tensor.BLOCK, old = 16, minhash_tensor.BLOCK
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_tensor.near_duplicates(docs, k=4).collect()}
    finally:
        minhash_tensor.BLOCK = old
    assert got == brute_groups(rows, 4, 80, 100)


def _exchanged(df):
    """Rows that exchanges of a query that has run have written, by the keys they were dealt by."""
    plan, out = df._jdf.queryExecution().executedPlan().toString(), []
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            out.append(line.split("hashpartitioning(")[1].split("#")[0])
    return out


@pytest.mark.parametrize("most", [1 << 28, 1 << 12])
def test_filter_in_rounds(spark, most):
    """However small what is broadcast, results stay, and rows that the filter finds alone go straight through, without an exchange."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"text {rng.randrange(900)}" if i % 3 else "the hot one", "en", "s", 1) for i in range(1200)] + [(None, None, "", "", 0), (5000, "", "", "", 0)], DOCS)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    want = {(d, max(x for x in g if x is not None), len(g)) for g in texts.values() for d in g}
    found = exact_dedup(docs, max_filter_bits=most)
    rows = found.collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == want and sum(r["kept"] for r in rows) == len(texts)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    straight = plan.split("Union")[1].split("Join")[0]
    assert "NOT maybe" in straight and "Aggregate" not in straight.split("Relation")[0]
    assert set(_exchanged(found)) <= {"text_sha256"}


def test_filter_shuffles_buckets(spark):
    """Pass one sends a row for each task and bucket, not for each text; repeated positions alone are in the words."""
    at = spark.range(0, 100_000, 1, 4).select((F.col("id") * 7 % (1 << 21)).alias("position"))
    at = at.unionByName(spark.createDataFrame([(7 * 5,), (7 * 9,), (3,), (3,)], "position long"))
    words = {r["word"]: r["mask"] for r in exact_dedup_module._repeated(at).collect()}
    assert words == {0: -(1 << 63) + (1 << 35) + (1 << 3)}
    assert "collect_list" in exact_dedup_module._repeated(at)._jdf.queryExecution().optimizedPlan().toString()


def test_grammar_has_no_frequent_pair():
    rng = np.random.default_rng(5)
    ids = rng.zipf(1.3, 60_000).clip(0, 900).astype(np.uint32)
    _, _, symbols = repair_tokens.repair(ids, 1000)
    pairs, at = np.unique((symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:], return_inverse=True)
    for p in np.flatnonzero(np.bincount(at) >= 8):
        where, n, last = np.flatnonzero(at == p), 0, -2
        for x in where:
            if x > last + 1:
                n, last = n + 1, x
        assert n < 8
