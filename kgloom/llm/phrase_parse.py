"""Document fingerprints by locally consistent parsing.

A text is cut into phrases by what stands there, not by where it stands.  Runs of one symbol are taken together; then
deterministic coin tossing relabels each symbol by the lowest bit in which it differs from its left neighbour and that
bit's value, four times over, until the labels are 0 to 5 with unlike neighbours; a phrase begins at every inner local
maximum.  Phrases are named by a hash of their symbols, and the names are the symbols of the next level, up to the one
name of the whole text.  A cut depends on five symbols to its left and one to its right, so equal substrings have equal
phrases but for a few at either end of each level, whatever precedes them.

A fingerprint is the whole text's name (16 hex digits) and ``BINS`` bytes (two digits each): the names of level ``LEAST``
and above are dealt into bins, each bin keeps its least name, and a byte stands for it, 0 for an empty bin.  Equal texts
have equal fingerprints; the share of agreeing bins, less what bytes agree by chance, estimates the Jaccard similarity of
two texts' phrases (``likeness``).

Texts move once, dealt by range in descending order of ``doc_id``; a task holds a row until its successor comes.  The last row of
each task meets the first row of the next one in a second, small job.

Defined cases: a null text is empty; an empty text has a name of zeros and empty bins, and likeness 1 to another empty
text, 0 to any other; rows of equal ``doc_id`` follow one another by a hash of their text, and null ``doc_id`` comes last; a
single document is its own successor; texts of any length are parsed whole; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import _BYTE, U, counter_hash, mix64, slices, string_buffers
from .shared import sparing, stored

BINS = 128
LEAST = 2  # level of the smallest phrases in a fingerprint: some nine bytes each
_CHUNK = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_RUN, _SIZE = counter_hash(0x10CA1, 2) | U(1)


def _first_coin() -> np.ndarray:
    """Place of the lowest set bit of a byte; 0 for none."""
    x = np.arange(256)
    return np.where(x > 0, np.log2(np.maximum(x & -x, 1)), 0).astype(np.uint8)


_LOW = _first_coin()
#: A number whose 64 shifts have unlike top six bits, and the shift of each.
_ODD = U(0x03F79D71B4CB0A89)
_SHIFT = np.zeros(64, np.uint8)
with np.errstate(over="ignore"):
    for _i in range(64):
        _SHIFT[int((_ODD << U(_i)) >> U(58))] = _i


def coins(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, neighbours' unlike where their symbols are; ``first`` marks each text's first symbol."""
    if symbols.dtype == np.uint8:
        label = symbols
    else:
        differ = np.empty_like(symbols)
        differ[:1] = 1
        np.bitwise_xor(symbols[1:], symbols[:-1], out=differ[1:])
        differ[first] = 1
        with np.errstate(over="ignore"):
            differ &= ~differ + U(1)
            place = _SHIFT[((differ * _ODD) >> U(58)).astype(np.intp)]
        label = place * np.uint8(2) + ((symbols & differ) != 0)
    for _ in range(4 if symbols.dtype == np.uint8 else 3):
        differ = np.empty_like(label)
        differ[:1] = 1
        np.bitwise_xor(label[1:], label[:-1], out=differ[1:])
        differ[first] = 1
        place = _LOW[differ]
        label = place * np.uint8(2) + ((label >> place) & np.uint8(1))
    return label


def phrase_starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each text's start and at local maxima of the labels that are not its first two or last symbols."""
    label = coins(symbols, first)
    begin = first.copy()
    if len(label) > 3:
        inner = label[2:-1]
        top = (inner > label[1:-2]) & (inner > label[3:])
        begin[2:-1] |= top & ~first[1:-2] & ~first[3:]
    return np.flatnonzero(begin)


def phrase_names(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A 64-bit name of each phrase from its symbols in their order."""
    ends = np.append(begin[1:], len(symbols))
    out = np.empty(len(begin), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(ends, begin[i] + _CHUNK, "right")))
            size = ends[i:j] - begin[i:j]
            place = np.arange(begin[i], ends[j - 1]) - np.repeat(begin[i:j], size)
            factor = counter_hash(0x9A5E, int(size.max())) | U(1)
            total = np.add.reduceat(symbols[begin[i] : ends[j - 1]] * factor[place], begin[i:j] - begin[i])
            out[i:j] = mix64(total + size.astype(U) * _SIZE)
            i = j
    return out


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each text (UTF-8 bytes between offsets), and the least phrase name of each of its bins."""
    n = len(offsets) - 1
    root, least = np.zeros(n, U), np.full(n * BINS, _NONE)
    symbols, row, level = data, np.repeat(np.arange(n), np.diff(offsets)), 0

    def keep(row: np.ndarray, names: np.ndarray) -> None:
        np.minimum.at(least, row * BINS + (names & U(BINS - 1)).astype(np.int64), names >> U(7))

    while len(symbols):
        first = np.ones(len(symbols), bool)
        first[1:] = row[1:] != row[:-1]
        new = first.copy()
        new[1:] |= symbols[1:] != symbols[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(symbols)))
        symbols, row, first = symbols[at], row[at], first[at]
        named = _BYTE[symbols] if not level else symbols.copy()
        again = size > 1
        with np.errstate(over="ignore"):
            named[again] = mix64(named[again] + size[again].astype(U) * _RUN)
        begin = phrase_starts(symbols, first)
        symbols, row, level = phrase_names(named, begin), row[begin], level + 1
        whole = np.bincount(row, minlength=n)[row] == 1
        root[row[whole]] = symbols[whole]
        kept = np.ones(len(row), bool) if level >= LEAST else whole
        keep(row[kept], symbols[kept])
        symbols, row = symbols[~whole], row[~whole]
    return root, least.reshape(n, BINS)


def fingerprints(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of 8 + ``BINS`` bytes for each text of a column; null is empty."""
    data, offsets = string_buffers(column)
    root, least = parse(data, offsets)
    byte = np.where(least == _NONE, 0, 1 + mix64(least) % U(255)).astype(np.uint8)
    return np.concatenate([root.astype(">u8").view(np.uint8).reshape(-1, 8), byte], 1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity (0 to 1) of the phrases of fingerprints in rows of equal number; equal ones have 1."""
    x, y = a[:, 8:], b[:, 8:]
    used = ((x > 0) | (y > 0)).sum(1)
    both = ((x > 0) & (y > 0)).sum(1)
    agree = ((x == y) & (x > 0)).sum(1)
    by_chance = (both - agree) / 254
    found = np.clip((agree - by_chance) / np.maximum(used, 1), 0, 1)
    return np.where((a == b).all(1), 1.0, found)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()),
    ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])
_ROW_SQL = "kind int, part int, doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_DONE, _HEAD, _TAIL = 0, 1, 2


def _binary(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat)]).cast(pa.binary())


def _finished(part: int, ids: list, texts: list[str], marks: np.ndarray, following: list[str], next_marks: np.ndarray) -> pa.RecordBatch:
    edited = [_edited(t, f) for t, f in zip(texts, following, strict=True)]
    column = pa.array(edited, pa.large_string())
    own = fingerprints(column)
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, _DONE, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()), _binary(marks), _binary(own),
        pa.array(likeness(marks, own)), pa.array(likeness(marks, next_marks)), pa.nulls(n, pa.string()),
    ], schema=_ROW)


def _open(kind: int, part: int, doc: int | None, text: str, mark: np.ndarray) -> pa.RecordBatch:
    blank = pa.nulls(1, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([doc], pa.int64()), pa.nulls(1, pa.int64()), blank, _binary(mark), blank,
        pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([text], pa.string()),
    ], schema=_ROW)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text) in order: each with the one after it; the first and the last as they are."""
    held: tuple[int | None, str, np.ndarray] | None = None
    part = 0
    for batch in batches:
        at = 0
        for piece in slices(batch.column("text")):
            ids = batch.column("doc_id").slice(at, len(piece)).to_pylist()
            at += len(piece)
            texts, marks = [t or "" for t in piece.to_pylist()], fingerprints(piece)
            if held is None:
                part = batch.column("part")[0].as_py()
                yield _open(_HEAD, part, ids[0], texts[0], marks[:1])
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], marks])
            if len(ids) > 1:
                yield _finished(part, ids[:-1], texts[:-1], marks[:-1], texts[1:], marks[1:])
            held = ids[-1], texts[-1], marks[-1:]
    if held is not None:
        yield _open(_TAIL, part, *held)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text, fingerprint, next_text, next_fingerprint): each finished."""
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i in range(batch.num_rows):
            mark, after = (np.frombuffer(c[k][i], np.uint8)[None] for k in ("fingerprint", "next_fingerprint"))
            yield _finished(c["part"][i], [c["doc_id"][i]], [c["text"][i]], mark, [c["next_text"][i]], after)


def phrase_fingerprints(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of ``docs``.

    The edited text has the last half of its code points (rounded down) replaced by the first as many of the next document
    in descending order of ``doc_id``; after the last one comes the first.  ``tasks`` is left to Spark by default.
    """
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    dealt = ordered.repartitionByRange(*([tasks] if tasks else []), *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    found = stored(dealt.mapInArrow(sparing(_chain), _ROW_SQL), "phrases")
    # a row for each task, and its successor; texts stay out of the window
    heads = found.filter(F.col("kind") == _HEAD)
    turn = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead("part").over(turn), F.min("part").over(Window.partitionBy())).alias("next_part"))
    after = heads.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    tails = found.filter(F.col("kind") == _TAIL).join(follow, "part").join(after, "next_part")
    closed = tails.select("part", "doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_close, _ROW_SQL)
    shown = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return found.filter(F.col("kind") == _DONE).unionByName(closed).select("doc_id", "n_chars", *shown, "near_edited", "near_next")
