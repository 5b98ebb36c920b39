"""What Python workers hold at once: bounded batches and slices, a table that grows, shards of the size asked for."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from kgloom.llm import mix_flow, repair_tokens, shared, substring_chains, toxicity_chain, winnow
from kgloom.llm.bytewords import ALNUM, word_slices
from kgloom.llm.queries import TOKENIZER, tokenizer_path
from pyspark.sql import functions as F


def peak(run):
    """Most bytes that ``run`` holds beyond what stood before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_stored_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "b"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('word ', 400) AS text")
    rows = shared.stored(docs.mapInArrow(sizes, "n long, b long"), "batches").collect()
    assert sum(r["n"] for r in rows) == 10_000 and max(r["b"] for r in rows) < 5 << 20
    assert spark.conf.get(key, None) == before


def test_word_slices_hold_little():
    column = pa.array([f"word{i} " * 40 for i in range(20_000)])
    assert column.nbytes > 6 << 20
    assert peak(lambda: [None for _ in word_slices(column, ALNUM)]) < 12 << 20


def test_rounds_hold_little():
    ids = np.random.default_rng(1).zipf(1.3, 1 << 20).clip(1, 49_999).astype(np.uint16)
    assert peak(lambda: repair_tokens.repair(ids, 50_000)) < 64 << 20


def test_table_grows_with_its_pieces():
    pytest.importorskip("public_tokenizers")
    enc = repair_tokens.PieceEncoder(tokenizer_path(TOKENIZER))
    assert enc.keys.nbytes + enc.entry.nbytes < 4 << 20
    texts = [" ".join(f"piece{i}x{j}" for j in range(200)) for i in range(400)]
    for _ in range(2):  # pieces from before and after each growth are found again
        ids, offsets = enc.encode(pa.array(texts))
        for i in (0, 199, 399):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.tokenizer.encode(texts[i], add_special_tokens=False).ids
    assert enc.count > enc.SLOTS // 2 and 2 * enc.count <= len(enc.keys)


def test_a_shard_ends_with_the_document_that_fills_it(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(i, f"text {i} has some words " * 5) for i in range(600)], "doc_id long, text string").coalesce(1)
    shards = repair_tokens.write_shards(docs, tokenizer_path(TOKENIZER), shard_ids=1000)
    rows = repair_tokens.read_documents(shards).collect()
    most = max(r["n_tokens"] for r in rows)
    assert sorted(r["doc_id"] for r in rows) == list(range(600)) and most < 100
    sizes = [[r["n_ids"] for r in shards.filter(f"part = {p['part']}").orderBy("seq").collect()] for p in shards.select("part").distinct().collect()]
    assert all(1000 <= n < 1000 + most for own in sizes for n in own[:-1]) and all(own[-1] < 1000 + most for own in sizes)


def test_passage_workers_give_memory_back(monkeypatch):
    """Seeds come in small batches, and free memory goes back when a task's last one is out."""
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))

    class Docs:
        def mapInArrow(self, run, kind):
            return run

    texts = [" ".join(f"w{i * j}" for j in range(400)) for i in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3_000)), pa.array([0] * 3_000), pa.array(texts)], names=["doc_id", "part", "text"])
    sizes = []
    for out in substring_chains._seeds(Docs(), 6, 12, 50)(iter([batch])):
        assert not calls
        sizes.append(out.num_rows)
    assert calls == [1] and len(sizes) > 8


def test_filters_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Rows go out a slice at a time, and free memory goes back when a task's last one is out."""
    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))

    class Docs:
        sparkSession, schema, run = spark, None, None

        def mapInArrow(self, run, kind):
            self.run = run
            return self

    texts = [f"row {i} " + "word " * 400 for i in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts)], names=["doc_id", "text"])
    items = spark.createDataFrame([(0, "row 7 word")], "item_id long, text string")
    chain = toxicity_chain.ClassifierChain(["toxic"], np.zeros(0, np.uint64)).fit([], np.zeros((0, 1)), np.zeros(0))
    for found, lost in ((winnow.drop_contaminated(Docs(), items), {7}), (toxicity_chain.drop_toxic(Docs(), chain), set())):
        calls.clear()
        kept, sizes = set(), []
        for out in found.run(iter([batch])):
            assert not calls
            kept |= set(out.column(0).to_pylist())
            sizes.append(out.num_rows)
        assert calls == [1] and len(sizes) > 2 and kept == set(range(1_000)) - lost


def test_the_mix_plan_starts_no_python_workers(spark, monkeypatch, capsys):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('word ', cast(id AS int)) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    mix_flow.mix_sources(docs, F.array("source")).explain()
    assert "ExistingRDD" not in capsys.readouterr().out


def test_stages_bound_the_batches_that_the_caller_writes(spark, monkeypatch):
    from kgloom.sources.store import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    session = spark.newSession()
    small_batches(session)
    assert int(session.conf.get(key)) <= 4 << 20
    session.conf.set(key, "1000000")
    small_batches(session)
    assert session.conf.get(key) == "1000000"
