"""A stored positional inverted index over the names and observations of a graph.

A segment is two tables.  ``postings`` has a row for each term and block of at most ``BLOCK`` texts: which texts (entity_id, idx), how
long each is and at which positions the term stands, and the block's greatest count and least length.  It is partitioned by source (name or
body) and by a hash of the term's first two letters, sorted by term within, with a Bloom filter on it: a search reads the partitions of its
words and, in them, their row groups; a prefix of two letters or more has one partition too.  Integers are stored by their differences (the
delta encodings of Parquet's second format).  ``lengths`` has a row for each text.

A change is a new segment (insert) or a list of dead texts beside each older one (delete); ``merged`` writes all that live as one segment.
Counts of texts and tokens are kept with each segment, so a search counts nothing but the texts of its words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .store import KG, stored

BLOCK = 4096
WORDS = 1 << 20
BUCKETS = 64
LEAD = 2
NAME, BODY = "name", "body"
_DOC = "struct<entity_id: bigint, idx: bigint, len: int, pos: array<int>>"
_POSTING = f"source string, bucket int, term string, docs array<{_DOC}>, max_tf int, min_len int"
_LENGTH = "source string, entity_id long, idx long, len int"


def bucket_of(term: str) -> int:
    return zlib.crc32(term[:LEAD].encode()) % BUCKETS


def _bucket(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, LEAD)) % BUCKETS).cast("int")


def texts_of(kg: KG) -> DataFrame:
    """source, entity_id, idx, text of all names and observations."""
    names = kg.entities.select(F.lit(NAME).alias("source"), F.col("id").alias("entity_id"), F.lit(0).cast("long").alias("idx"), F.col("name").alias("text"))
    return names.unionByName(kg.observations.select(F.lit(BODY).alias("source"), "entity_id", F.col("idx").cast("long").alias("idx"), F.col("body").alias("text")))


@dataclass(frozen=True)
class Segment:
    postings: DataFrame
    lengths: DataFrame
    totals: dict[str, tuple[int, int]]  # source: texts, tokens
    dead: DataFrame | None = None  # source, entity_id, idx

    def living(self, rows: DataFrame) -> DataFrame:
        return rows if self.dead is None else rows.join(self.dead, ["source", "entity_id", "idx"], "left_anti")


def _totals(lengths: DataFrame) -> dict[str, tuple[int, int]]:
    rows = lengths.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).collect()  # a row for each source
    return {r["source"]: (r["n"], r["t"]) for r in rows}


def _write(blocks: DataFrame, lengths: DataFrame, path: str) -> Segment:
    """A segment of blocks (source, term, docs, max_tf, min_len)."""
    rows = blocks.select("source", _bucket(F.col("term")).alias("bucket"), "term", "docs", "max_tf", "min_len")
    key = ["source", "bucket", "term"]
    writer = rows.repartitionByRange(*key).sortWithinPartitions(*key).write.partitionBy("source", "bucket").option("parquet.block.size", 16 << 20)
    writer.option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", 1 << 16).option("parquet.writer.version", "PARQUET_2_0").parquet(f"{path}/postings")
    dealt = lengths.repartitionByRange("source", "entity_id").sortWithinPartitions("source", "entity_id")
    dealt.write.option("parquet.bloom.filter.enabled#entity_id", "true").option("parquet.bloom.filter.expected.ndv#entity_id", 1 << 17).parquet(f"{path}/lengths")
    read = blocks.sparkSession.read
    written = read.schema(_LENGTH).parquet(f"{path}/lengths")
    return Segment(read.schema(_POSTING).parquet(f"{path}/postings"), written, _totals(written))


def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The postings of some texts (source, entity_id, idx, t), a row for each source and term."""
    source, entity, idx, t = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("source", "entity_id", "idx", "t"))
    kinds, words = source.dictionary_encode(), t.flatten().dictionary_encode()
    entity, idx, size = entity.to_numpy(), idx.to_numpy(), t.value_lengths().to_numpy().astype(np.int64)
    place = np.empty(len(size), np.int64)
    place[np.lexsort((idx, entity))] = np.arange(len(size))  # texts of a block stand by their keys
    text = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    term = kinds.indices.to_numpy().astype(np.int64)[text] * len(words.dictionary) + words.indices.to_numpy()
    own = term * len(size) + place[text]
    order = np.argsort(own, kind="stable")  # positions of a text ascend as they stand
    own, term, text, pos = own[order], term[order], text[order], pos[order]
    post = np.flatnonzero(np.diff(own, prepend=-1))
    text, term = text[post], term[post]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    offsets = lambda begins, n: pa.array(np.append(begins, n), pa.int32())
    places = pa.ListArray.from_arrays(offsets(post, len(pos)), pa.array(pos, pa.int32()))
    docs = pa.StructArray.from_arrays([pa.array(entity[text]), pa.array(idx[text]), pa.array(size[text], pa.int32()), places], ["entity_id", "idx", "len", "pos"])
    most, least = (f.reduceat(v, first) if len(first) else v for f, v in ((np.maximum, np.diff(np.append(post, len(pos)))), (np.minimum, size[text])))
    kind, word = np.divmod(term[first], max(1, len(words.dictionary)))
    return pa.RecordBatch.from_arrays([kinds.dictionary.take(pa.array(kind)), words.dictionary.take(pa.array(word)), pa.ListArray.from_arrays(offsets(first, len(docs)), docs), pa.array(most, pa.int32()), pa.array(least, pa.int32())], names=["source", "term", "docs", "max_tf", "min_len"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of texts (source, entity_id, idx, t) that follow one another: of ``BLOCK`` texts at most, or of so many words that ``WORDS`` are reached."""
    held, rows, words = [], 0, 0
    for batch in batches:
        ends = np.cumsum(batch.column("t").value_lengths().to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            # as many as there is room for, the one that reaches the bound among them
            n = min(batch.num_rows - start, BLOCK - rows, int(np.searchsorted(ends, before + WORDS - words)) + 1 - start)
            held.append(batch.slice(start, n))
            start, rows, words = start + n, rows + n, words + int(ends[start + n - 1] - before)
            if rows >= BLOCK or words >= WORDS:
                yield _block(held)
                held, rows, words = [], 0, 0
    if held:
        yield _block(held)


def _segment(texts: DataFrame, path: str) -> Segment:
    """A segment of texts (source, entity_id, idx, text); texts that follow one another share a block, gathered in their task."""
    split = stored(texts.select("source", "entity_id", "idx", F.coalesce(tokens("text"), F.array().cast("array<string>")).alias("t")), "text-tokens")
    blocks = split.mapInArrow(_blocks, f"source string, term string, docs array<{_DOC}>, max_tf int, min_len int")
    return _write(blocks, split.select("source", "entity_id", "idx", F.size("t").alias("len")), path)


@dataclass(frozen=True)
class TextIndex:
    path: str
    segments: tuple[Segment, ...]

    def _fresh(self) -> str:
        return f"{self.path}/segment-{uuid.uuid4().hex}"

    def insert(self, texts: DataFrame) -> TextIndex:
        """With texts (source, entity_id, idx, text) that it doesn't have yet: a segment of their own."""
        return replace(self, segments=(*self.segments, _segment(texts, self._fresh())))

    def delete(self, keys: DataFrame) -> TextIndex:
        """Without the texts of ``keys`` (source, entity_id, idx), as they stand in the segments there are."""
        gone = stored(keys.select("source", "entity_id", "idx").distinct(), "text-dead")
        out = []
        for s in self.segments:
            dead = gone if s.dead is None else stored(s.dead.unionByName(gone).distinct(), "text-dead")
            out.append(replace(s, dead=dead, totals=_totals(s.lengths.join(dead, ["source", "entity_id", "idx"], "left_anti"))))
        return replace(self, segments=tuple(out))

    def delete_entities(self, ids: DataFrame) -> TextIndex:
        """Without all texts of these entities (id)."""
        own = [s.lengths.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("source", "entity_id", "idx") for s in self.segments]
        return self.delete(reduce(DataFrame.unionByName, own)) if own else self

    def merged(self) -> TextIndex:
        """All living texts as one segment."""
        rows = [s.living(s.postings.select("source", "term", F.inline("docs"))) for s in self.segments]
        lengths = stored(reduce(DataFrame.unionByName, [s.living(s.lengths) for s in self.segments]), "text-lengths")
        blocks = max(1, lengths.count() // BLOCK)
        flat = reduce(DataFrame.unionByName, rows).withColumn("block", F.pmod(F.xxhash64("entity_id", "idx"), F.lit(blocks)))
        doc = F.struct("entity_id", "idx", F.col("len").cast("int").alias("len"), F.col("pos").cast("array<int>").alias("pos"))
        dealt = flat.groupBy("source", "term", "block").agg(F.array_sort(F.collect_list(doc)).alias("docs"), F.max(F.size("pos")).alias("max_tf"), F.min("len").cast("int").alias("min_len"))
        return replace(self, segments=(_write(dealt.drop("block"), lengths.select("source", "entity_id", "idx", "len"), self._fresh()),))

    def totals(self, source: str) -> tuple[int, int]:
        """Texts and tokens of a source."""
        n, t = zip(*(s.totals.get(source, (0, 0)) for s in self.segments), strict=True) if self.segments else ((), ())
        return sum(n), sum(t)

    def hits(self, source: str, words: Sequence[tuple[str, bool]]) -> DataFrame:
        """term, entity_id, idx, len, pos of the texts of ``source`` with any of the words (or, if marked, of what begins with one)."""
        exact = sorted({w for w, prefix in words if not prefix})
        leads = sorted({w for w, prefix in words if prefix})
        wanted, buckets = F.lit(False), sorted({bucket_of(w) for w in exact} | {bucket_of(w) for w in leads if len(w) >= LEAD})
        if exact:
            wanted = wanted | F.col("term").isin(*exact)
        for w in leads:
            wanted = wanted | F.col("term").startswith(w)
        out = []
        for s in self.segments:
            rows = s.postings.filter(F.col("source") == source)
            if all(len(w) >= LEAD for w in leads):
                rows = rows.filter(F.col("bucket").isin(*buckets))
            out.append(s.living(rows.filter(wanted).select("source", "term", F.inline("docs"))).select("term", "entity_id", "idx", "len", "pos"))
        return reduce(DataFrame.unionByName, out)

    def terms(self, source: str) -> DataFrame:
        """term, documents (entities), occurrences."""
        rows = reduce(DataFrame.unionByName, [s.living(s.postings.filter(F.col("source") == source).select("source", "term", F.inline("docs"))) for s in self.segments])
        return rows.groupBy("term").agg(F.countDistinct("entity_id").alias("documents"), F.sum(F.size("pos")).alias("occurrences"))


def build_text_index(kg: KG, path: str) -> TextIndex:
    return TextIndex(path, (_segment(texts_of(kg), f"{path}/segment-{uuid.uuid4().hex}"),))
