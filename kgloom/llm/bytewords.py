"""Words and 64-bit word hashes of Arrow string batches, computed on the raw UTF-8 bytes.

A batch is treated as one byte buffer: word bounds come from a 256-entry class table and the hash of a
word is the sum, taken from a running one, of a value of each byte times a key of its place in the word (mod 2**64),
then finalised with a bijective mixer.  Values and keys are unrelated 64-bit numbers, so that no pattern of a word, however
long, makes it meet another one's hash (a polynomial's powers would).  Work buffers cover a slice of the words at a time, so their size does not follow the
batch.  All delimiters used here are ASCII, so cutting UTF-8 at byte level is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SLICE_BYTES = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 3  # odd, and 3 mod 4: base - 1 has a single factor of two


def _is(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: word bytes of ``[^\x20\x09-\x0D]+``
NON_SPACE = ~_is((0x20, 0x20), (0x09, 0x0D))
#: word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM = _is((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over uint64."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def counter_hash(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


_BYTE = counter_hash(0xB17E, 256)


class _Powers:
    """base**k and its inverse for k below the longest slice so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, _SLICE_BYTES + 1024)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, U(_BASE))]), dtype=U)
                self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, U(pow(_BASE, -1, 1 << 64)))]), dtype=U)
        return self.up, self.down


_POWERS = _Powers()


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_bounds(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` inside each row: starts, ends, and each row's first run (n + 1 values)."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = member[cut]
    last[cut - 1] = member[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


class _Keys:
    """Keys of places in a span, as many as the longest so far needs."""

    def __init__(self) -> None:
        self.known = counter_hash(0x5EED, _SLICE_BYTES + 1024) | U(1)

    def get(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = counter_hash(0x5EED, n) | U(1)
        return self.known


_KEYS = _Keys()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are ascending and disjoint."""
    out = np.empty(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + _SLICE_BYTES, "right")))
            a, b = (starts[i:j] - base).astype(np.int32), (ends[i:j] - base).astype(np.int32)
            part = data[base : base + b[-1]]
            keys = _KEYS.get(len(part))
            place = np.arange(len(part), dtype=np.int32)
            place -= np.repeat(a, np.diff(a, append=np.int32(len(part))))
            run = np.zeros(len(part) + 1, U)
            np.cumsum(_BYTE[part] * keys[place], dtype=U, out=run[1:])
            out[i:j] = (run[b] - run[a]) + (b - a).astype(U)
            i = j
    return mix64(out)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each span; of all of it where it is shorter."""
    return span_hashes(data, starts, np.minimum(ends, starts + size))


def words(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes, word starts and ends, and each row's first word (n + 1 values)."""
    data, offsets = string_buffers(column)
    data = LOWER[data]
    starts, ends, rows = span_bounds(table[data], offsets)
    return data, starts, ends, rows


def word_hashes(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and each row's first word (n + 1 values)."""
    data, starts, ends, rows = words(column, table)
    return span_hashes(data, starts, ends), rows


def slices(column, most: int = 1 << 19) -> Iterator[pa.Array]:
    """The column a few rows at a time: at most ``most`` bytes of text, or one row.

    An Arrow batch is bounded in rows only; work arrays are many times its text, so they follow these slices.
    """
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from slices(chunk, most)
        return
    _, offsets = string_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield column.slice(i, j - i)
        i = j


def word_slices(column, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word_hashes`` of each slice."""
    for part in slices(column):
        yield word_hashes(part, table)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (len(h) - k + 1 values)."""
    if len(h) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - k + 1, U)
        for i, c in enumerate(counter_hash(0x6A3 + 1000 * k, k)):
            total += h[i : len(h) - k + 1 + i] * (c | U(1))
        return mix64(total)


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word hashes from each start to its end, and of their number."""
    up, down = _POWERS.get(len(h) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], dtype=U, out=run[1:])
        return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(U) * U(_BASE))
