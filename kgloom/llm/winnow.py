"""Benchmark decontamination by winnowing.

Of every run of ``w`` consecutive k-grams the one of least hash is a fingerprint, on both sides, so any shared
run of ``w + k - 1`` words has a fingerprint in common.  Windows are 10 words (k = 6, w = 5); an item of
L < 10 words is one window of L words with k = min(6, L), w = L - k + 1, so the guarantee covers it too.
Fingerprints of items are joined with those of documents, and a hit extends to left and right as far as the
words agree; spans of at least a whole window count.

The items' side is sent to the tasks in portions of at most ``max_item_words`` words, which bounds what is
broadcast; a larger benchmark takes a pass over the documents for each portion, and the passes' spans are united.

Defined cases: null or empty texts and items have no words; equal items count by their ids; long texts are read
whole; other columns are ignored; rows with equal doc_id are rows of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, U, gram_hashes, word_hashes, word_slices
from .shared import sparing, stored

WINDOW = 10
K = 6


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least gram (the rightmost of equals) of every ``w`` consecutive ones."""
    n = len(grams)
    if n < w or not n:
        return np.zeros(0, np.int64)
    if w == 1:
        return np.arange(n)
    best = np.arange(n - w + 1)
    low = grams[: n - w + 1].copy()
    for i in range(1, w):
        other = grams[i : n - w + 1 + i]
        better = other <= low
        low = np.where(better, other, low)
        best = np.where(better, np.arange(i, n - w + 1 + i), best)
    keep = np.ones(len(best), bool)
    keep[1:] = best[1:] != best[:-1]
    return best[keep]


class ItemIndex:
    """Fingerprints of some items, by window length, for the search in document words."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids = ids
        self.h, rows = word_hashes(pa.array(texts, pa.string()), ALNUM)
        self.begin, self.end = rows[:-1], rows[1:]
        length = np.minimum(self.end - self.begin, WINDOW)
        self.by_length = []
        for t in np.unique(length[length > 0]).tolist():
            k = min(K, t)
            w = t - k + 1
            item, at = [], []
            for i in np.flatnonzero(length == t).tolist():
                p = winnowed(gram_hashes(self.h[self.begin[i] : self.end[i]], k), w)
                item.append(np.full(len(p), i))
                at.append(p + self.begin[i])
            item, at = np.concatenate(item), np.concatenate(at)
            key = gram_hashes_at(self.h, at, k)
            order = np.argsort(key, kind="stable")
            self.by_length.append((t, k, w, key[order], item[order], at[order]))

    def spans(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, start and end of every maximal shared run of at least a window in a document's words."""
        found = []
        for t, k, w, key, item, at in self.by_length:
            grams = gram_hashes(h, k)
            if len(grams) < w:
                continue
            lo = np.searchsorted(key, grams)
            hit = np.flatnonzero(key[np.minimum(lo, len(key) - 1)] == grams)
            if not len(hit):
                continue
            pos = np.intersect1d(hit, winnowed(grams, w))
            lo, hi = np.searchsorted(key, grams[pos]), np.searchsorted(key, grams[pos], "right")
            n = hi - lo
            pos = np.repeat(pos, n)
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            it, ip = item[which], at[which]
            a, b = self._extend(h, pos, ip, k, self.begin[it], self.end[it])
            keep = b - a >= t
            found.append(np.stack([it[keep], a[keep], b[keep]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, 1), axis=1))

    def _extend(self, h, pos, ip, k, begin, end):
        """Grow each hit by a word at a time, all hits together, while the words agree."""
        a, b, ia, ib = pos.copy(), pos + k, ip.copy(), ip + k
        go = np.arange(len(pos))
        while len(go := go[(a[go] > 0) & (ia[go] > begin[go])]):
            go = go[h[a[go] - 1] == self.h[ia[go] - 1]]
            a[go] -= 1
            ia[go] -= 1
        go = np.arange(len(pos))
        while len(go := go[(b[go] < len(h)) & (ib[go] < end[go])]):
            go = go[h[b[go]] == self.h[ib[go]]]
            b[go] += 1
            ib[go] += 1
        return a, b


def gram_hashes_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return gram_hashes(h, k)[at] if len(at) else np.zeros(0, U)


def _portions(items: DataFrame, max_item_words: int) -> Iterator[tuple[list, list]]:
    ids, texts, n = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        n += len(row["text"] or "") // 2 + 1
        if n >= max_item_words:
            yield ids, texts
            ids, texts, n = [], [], 0
    yield ids, texts


_FOUND = "row long, doc_id long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def find_spans(docs: DataFrame, items: DataFrame, max_item_words: int = 1 << 20) -> DataFrame:
    """For each document the spans of words it shares with items, and those items' ids as strings.

    One row for each document and portion of the items; ``row`` tells the documents apart.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    portions = _portions(items, max_item_words)
    first, second = next(portions), next(portions, None)
    if second is not None:  # passes are united by row: they must read the same numbers
        numbered = stored(numbered, "leak-rows")
    out, many = None, None
    for ids, texts in itertools.chain([first], [second] if second is not None else [], portions):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, texts = sent.value
            index = ItemIndex([str(x) for x in ids], texts)
            for batch in batches:
                count, spans, names = [], [], []
                for h, rows in word_slices(batch.column("text"), ALNUM):
                    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                        it, s, e = index.spans(h[a:b])
                        count.append(b - a)
                        spans.append([{"s": x, "e": y} for x, y in sorted(set(zip(s.tolist(), e.tolist(), strict=True)))])
                        names.append(sorted({index.ids[i] for i in it.tolist() if ids[i] is not None}))
                kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_words", "spans", "items"],
                )

        found = numbered.mapInArrow(sparing(run), _FOUND)
        many, out = (True, out.unionByName(found)) if out is not None else (False, found)
    return out if not many else stored(out, "leak-spans").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def covered(spans: str = "spans"):
    """Words under at least one of the spans, which may overlap."""
    walk = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["upto"], x["s"]))).alias("n"), F.greatest(acc["upto"], x["e"]).alias("upto")
        ),
    )
    return walk["n"]


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    found = find_spans(docs, items)
    return found.select(
        "doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items",
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, max_item_words: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; no row moves."""
    for ids, texts in _portions(items, max_item_words):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*sent.value)
            for batch in batches:
                start = 0
                for h, rows in word_slices(batch.column("text"), ALNUM):  # a slice goes out before the next is read
                    clean = [not len(index.spans(h[a:b])[0]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                    yield batch.slice(start, len(clean)).filter(pa.array(clean, pa.bool_()))
                    start += len(clean)

        docs = docs.mapInArrow(sparing(run), docs.schema)
    return docs
