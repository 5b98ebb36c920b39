"""Exact dedup with a two-pass Bloom filter, in DataFrame functions only.

A narrow table (row number, doc_id, sha-256, filter position) is written once, so texts are read once.

Pass one finds the positions that two rows or more hit.  A task packs the positions that it hits in a bucket of ``BUCKET`` of them into one row, so
what is shuffled are a few bytes a text and a row for each task and bucket; a position that a task hits often is sent once, with a mark.  Of what
meets in a bucket the repeated positions are kept as 64-bit words.

Pass two probes the words: a row whose bit is clear has no equal row and passes straight through, only the others shuffle, by the digest of their
whole text.  False positives cost a shuffled row and never change a result.  The filter has ``bits_per_row`` bits for each row.  What is broadcast
has ``max_filter_bits`` at most: a larger filter goes in rounds, each with the rows of one slice of the positions, which the narrow table
holds apart.

Texts that a thousandth of all rows have, at most a thousand of them, meet their group by broadcast, so no task gets a hot one.

Defined cases: a null text equals an empty one; of equal texts the row with the largest doc_id stays,
null doc_id below all others, and of rows equal in both, exactly one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lower_az, stored

BUCKET_BITS = 16
HOT = 1000


def _repeated(at: DataFrame) -> DataFrame:
    """word, mask: the positions of ``at`` that two rows or more hit, as bits of 64-bit words."""
    low = (1 << BUCKET_BITS) - 1
    mine = at.select(F.shiftright("position", BUCKET_BITS).alias("bucket"), F.spark_partition_id().alias("task"), F.expr(f"cast(position & {low} as int)").alias("p"))
    # of a task's positions each once, times two, and one more where the task hit it again
    own = mine.groupBy("bucket", "task").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    again = F.filter("ps", lambda x, i: (i > 0) & (F.get(F.col("ps"), i - 1) == x))
    once = own.select("bucket", F.concat(F.transform(F.array_distinct("ps"), lambda x: x * 2), F.transform(F.array_distinct(again), lambda x: x * 2 + 1)).alias("ms"))
    met = once.groupBy("bucket").agg(F.array_sort(F.flatten(F.collect_list("ms"))).alias("ms"))
    twice = F.filter("ms", lambda x, i: (x % 2 == 1) | ((i > 0) & (F.get(F.col("ms"), i - 1) == x)))
    found = met.select("bucket", F.explode(F.array_distinct(F.transform(twice, lambda x: F.shiftright(x, 1)))).alias("p"))
    word = F.shiftleft("bucket", BUCKET_BITS - 6) + F.shiftright("p", 6)
    return found.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("mask"))


def _flagged(at: DataFrame) -> DataFrame:
    """row, doc_id, text_sha256, maybe: whether another row may have the text."""
    words = stored(_repeated(at), "dedup-words")
    probed = at.withColumn("word", F.shiftright("position", 6)).join(F.broadcast(words), "word", "left")
    return probed.select("row", "doc_id", "text_sha256", F.expr("coalesce(getbit(mask, cast(position & 63 as int)), 0) = 1").alias("maybe"))


def exact_dedup(docs: DataFrame, bits_per_row: int = 16, max_filter_bits: int = 1 << 28) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    text = lower_az(F.col("text"))
    narrow = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
        .select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.xxhash64("t").alias("h"))
        .withColumn("row", F.monotonically_increasing_id()),
        "dedup-hashes",
    )
    n = narrow.count()
    bits = 1 << (max(1024, n * bits_per_row) - 1).bit_length()
    at = narrow.withColumn("position", F.pmod("h", F.lit(bits)))
    if bits <= max_filter_bits:
        flagged = stored(_flagged(at), "dedup-flags")
    else:
        slices = bits // max_filter_bits
        apart = stored(at.withColumn("slice", F.expr(f"cast(position div {max_filter_bits} as int)")), "dedup-slices", by="slice")
        rounds = (apart.filter(F.col("slice") == i).withColumn("position", F.col("position") % max_filter_bits) for i in range(slices))
        flagged = reduce(DataFrame.unionByName, [stored(_flagged(r), "dedup-flags") for r in rounds])
    maybe = flagged.filter("maybe")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("order")))
    groups = stored(maybe.groupBy("text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    hot = groups.filter(F.col("group_size") * HOT >= n)  # at most HOT rows
    rest = groups.filter(F.col("group_size") * HOT < n)

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (-F.col("row") == F.col("best.order")).alias("kept"), "text_sha256")

    keys = F.broadcast(hot.select("text_sha256"))
    shuffled = shown(maybe.join(F.broadcast(hot), "text_sha256")).unionByName(shown(maybe.join(keys, "text_sha256", "left_anti").join(rest, "text_sha256")))
    straight = flagged.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return straight.unionByName(shuffled)
