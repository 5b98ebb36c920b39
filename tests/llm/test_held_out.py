"""Classifiers on labels that they did not see: fitted on some of the labelled rows of the test tables, measured on the others."""

import os

import numpy as np
import pytest
from kgloom.llm.fm_quality import fit_quality, score_quality
from kgloom.llm.queries import CATEGORIES
from kgloom.llm.toxicity_chain import fit_chain, score_chain
from pyspark.sql import functions as F

TABLES = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def _tables(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return docs, labels, held, docs.join(labels.filter(held).select("doc_id"), "doc_id", "left_semi")


@needs_tables
def test_toxicity(spark):
    docs, labels, held, unseen = _tables(spark)
    chain = fit_chain(docs, labels.filter(~held), CATEGORIES)
    got = score_chain(unseen, chain).select("doc_id", (F.col("p_toxic") >= 0.5).alias("found")).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    toxic, found = (np.array([bool(r[c]) for r in got]) for c in ("toxic", "found"))
    print("toxicity", len(got), toxic.sum(), found[toxic].mean(), toxic[found].mean())
    assert toxic.sum() > 80 and found[toxic].mean() >= 0.85 and toxic[found].mean() >= 0.95


@needs_tables
def test_quality(spark):
    docs, labels, held, unseen = _tables(spark)
    model = fit_quality(docs, labels, usable=~held)
    got = score_quality(unseen, model).select("doc_id", "score").join(labels.select("doc_id", "quality"), "doc_id").collect()
    truth, score = np.array([r["quality"] for r in got]), np.array([r["score"] for r in got])
    good = score[truth == 1]
    area = np.mean([(good > x).mean() + (good == x).mean() / 2 for x in score[truth == 0]])
    print("quality", len(got), ((score >= 0.5) == truth).mean(), area)
    assert ((score >= 0.5) == truth).mean() >= 0.85 and area >= 0.9
