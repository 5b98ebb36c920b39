"""The pipeline's stages take effect, keep the columns of documents, and agree with their operators."""

import corpus_pipeline
import pytest
from kgloom.llm import queries

from .test_operators import DOCS, labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark, 120)
    more = spark.createDataFrame([(900, docs.filter("doc_id = 1").first()["text"], "en", "s", 1), (901, docs.filter("doc_id = 2").first()["text"] + " end", "en", "t", 1)], DOCS)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    item = docs.filter("doc_id = 4").first()["text"].split()
    spark.createDataFrame([(0, " ".join(item[10:30]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "stage")
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3]
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {4, 900, 901}


def test_run(spark, folder):
    pytest.importorskip("public_tokenizers")
    rows = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r["start"])
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
