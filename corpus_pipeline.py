"""A corpus pipeline of five operators: each stage's Parquet is the next one's documents.

In every stage null texts are empty, rows that repeat are rows of their own, an empty table gives an empty one, texts of any length are read whole,
and columns beside ``doc_id``, ``text`` and ``source`` pass through whatever they are called; what else a stage defines is said there.
Stages that hand whole rows to Python bound the session's Arrow batches in bytes, as their plans run when the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.minhash_tensor import drop_near_duplicates
from kgloom.llm.mix_flow import mixed
from kgloom.llm.queries import CATEGORIES, TOKENIZER, tokenizer_path
from kgloom.llm.repair_tokens import token_output
from kgloom.llm.shared import documents, stored
from kgloom.llm.toxicity_chain import drop_toxic, fit_chain
from kgloom.llm.winnow import drop_contaminated
from kgloom.sources.store import small_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go.

    An empty text is never toxic; without labelled rows nothing is; the fit takes labelled rows in the order of a hash of their id, so ties
    and repeated ids change nothing from run to run.
    """
    small_batches(spark)
    return drop_toxic(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.

    The one with the least id stays, of equal ids one; documents without words are linked with nothing and all stay.
    """
    return drop_near_duplicates(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    An item of fewer than ten words is one window; items without words, or an empty benchmark, take nothing out.
    """
    small_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own, ordered last; documents without words are never taken; equal places in the seeded order go by id and size.
    """
    return mixed(docs, F.array("source"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back: doc_id, start, n_tokens, ids_crc32.

    An empty text is its end id alone; null ids come first, equal ids are ordered by a hash of the text, then the text; other columns end here.
    """
    small_batches(spark)
    return token_output(docs, tokenizer_path(TOKENIZER), end_id=0).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_ids", token_ids)]

#: Linear models, seeded mixing and byte-pair ids have no SQL form: tests hold the operators of each stage against brute force or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
