"""Word and structure features of whole texts, and the labelled sample that models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, LOWER, NON_SPACE, U, counter_hash, prefix_hashes, span_bounds, span_hashes, string_buffers


def sample_rows(labels: DataFrame, columns: list[str], max_rows: int, seed: int = 5) -> DataFrame:
    """At most ``max_rows`` labelled doc_ids with ``columns`` as 0 or 1, in a seeded order of the ids.

    Repeated ids count once (the greatest mark); rows without an id or a mark are no labels.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in columns)).na.drop()
    return marks.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns)).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)


def unique_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct word hashes, their counts, and the rows' offsets (n + 1 values)."""
    data, offsets = string_buffers(column)
    starts, ends, rows = span_bounds(ALNUM[LOWER[data]], offsets)
    return _unique(span_hashes(LOWER[data], starts, ends), rows)


#: Bytes of a word that stand for its stem.
STEMS = (4, 5, 6, 7, 8)
_STEM = counter_hash(0x57E3, max(STEMS) + 1)


def stems(column) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of every word and of its stems of each length, and the rows' first words (n + 1 values).

    A-Z and the two-byte capitals of Latin-1 are lower-cased; a stem that is the whole word counts too.
    """
    data, offsets = string_buffers(column)
    data = LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[capital] += 0x20
    starts, ends, rows = span_bounds(ALNUM[data], offsets)
    return [span_hashes(data, starts, ends), *(prefix_hashes(data, starts, ends, n) ^ _STEM[n] for n in STEMS)], rows


def unique_stems(column) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct words and stems, and the rows' offsets (n + 1 values)."""
    hashes, rows = stems(column)
    found = [np.unique(np.concatenate([h[a:b] for h in hashes])) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, U), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])


class StemIndex:
    """Finds which of some words and stems each row has."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.often = np.zeros(1 << 20, bool)
        self.often[(hashes >> U(44)).astype(np.int64)] = True

    def hits(self, column) -> list[np.ndarray]:
        hashes, rows = stems(column)
        row, place = [], []
        for h in hashes if len(self.hashes) else ():
            at = np.flatnonzero(self.often[(h >> U(44)).astype(np.int64)])
            p = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            same = self.hashes[p] == h[at]
            row.append(np.searchsorted(rows, at[same], "right") - 1)
            place.append(p[same])
        if not row:
            return [np.zeros(0, np.int64)] * (len(rows) - 1)
        pairs = np.unique(np.concatenate(row) * np.int64(len(self.hashes)) + np.concatenate(place))
        row, place = pairs // len(self.hashes), pairs % len(self.hashes)
        return np.split(place, np.searchsorted(row, np.arange(1, len(rows) - 1))) if len(rows) > 1 else []


def _unique(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b > a:
            s = np.sort(h[a:b])
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            found.append(s[at])
            counts.append(np.diff(np.append(at, b - a)))
        else:
            found.append(np.zeros(0, U))
            counts.append(np.zeros(0, np.int64))
    size = [len(x) for x in found[1:]]
    return np.concatenate(found), np.concatenate(counts), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


#: Fixed order of the columns of ``structure``.
STRUCTURE = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "pipe", "punct", "newline", "wide", "distinct", "repeat", "alone")


def _table(text: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(text.encode())] = True
    return t


_CLASSES = {
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _table("0123456789"), "symbol": _table("#$%&*@^~<>{}[]\\="), "pipe": _table("|"),
    "punct": _table(".,;:!?"), "newline": _table("\n"), "wide": np.arange(256) >= 0x80,
}


def word_statistics(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``unique_words`` and a row of structure statistics for each text, from one pass over the bytes."""
    data, offsets = string_buffers(column)
    starts, ends, rows = span_bounds(ALNUM[LOWER[data]], offsets)
    h = span_hashes(LOWER[data], starts, ends)
    words, counts, at = _unique(h, rows)
    n = np.diff(offsets).astype(float)
    many = np.diff(rows).astype(float)
    total = np.maximum(n, 1)

    def share(table: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(table[data])
        return np.diff(np.searchsorted(where, offsets)) / total

    same = np.flatnonzero(h[1:] == h[:-1]) + 1 if len(h) else np.zeros(0, np.int64)
    same = same[~np.isin(same, rows)] if len(same) else same
    tokens, _, first = span_bounds(NON_SPACE[data], offsets)
    columns = {
        "log_bytes": np.log1p(n), "log_words": np.log1p(many), "word_bytes": np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[rows]) / np.maximum(many, 1),
        "distinct": np.diff(at) / np.maximum(many, 1), "repeat": np.diff(np.searchsorted(same, rows)) / np.maximum(many, 1),
        "alone": np.maximum(0, np.diff(first) - many) / np.maximum(np.diff(first), 1),
    } | {k: share(t) for k, t in _CLASSES.items()}
    return words, counts, at, np.stack([columns[c] for c in STRUCTURE], 1) if len(n) else np.zeros((0, len(STRUCTURE)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
