"""Token-ID output: shards of token ids under a Re-Pair grammar, with random access.

Documents are dealt into ranges of ascending ``doc_id``.  Each task encodes its texts and cuts the id
stream into shards; in every shard frequent pairs of neighbouring symbols are replaced by nonterminals,
round after round, until no pair is frequent.  A round counts pairs exactly and replaces many at once: an occurrence
goes where its pair is the most frequent of those that overlap there.  A shard holds the rules, the final symbols, the
length each rule expands to, the place of every 256th symbol in the ids and the documents' bounds, so any range of ids is
decoded from the symbols that cover it.

Shard (little endian): ``magic 'RPG2' | u32 first nonterminal | u32 rules | u64 symbols | u64 documents |
u64 ids | rules: 2 x u32 each | lengths: u32 for each rule | symbols: u16 or u32 | places: u32 for each
256 symbols | bounds: u64 (documents + 1)``.
Shards are the ``blob`` column of a Parquet table, so the writer's commit protocol covers lost executors.

Defined cases: null text is empty and has the end id alone; equal ``doc_id`` are ordered by a hash of the text, then the text; null
``doc_id`` come first; a text of any length is encoded whole and never leaves its shard; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import U, counter_hash, mix64, string_buffers
from .shared import give_back, sparing, stored

MAGIC = b"RPG2"
STRIDE = 256
_HEAD = struct.Struct("<4sIIQQQ")


# --- grammar -------------------------------------------------------------------------------------


def numbered(keys: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (two symbols of ``wide`` bits, 32 bits apart) ascending, and the number of each pair's own."""
    place = max(1, len(keys).bit_length())
    if not len(keys) or 2 * wide + place > 64:
        return np.unique(keys, return_inverse=True)
    # key and place in one word: a plain sort is several times faster than one that returns an order
    low, short = U((1 << wide) - 1), np.int32 if place < 32 else np.int64
    packed = keys >> U(32)
    packed <<= U(wide)
    packed |= keys & low
    packed <<= U(place)
    packed |= np.arange(len(keys), dtype=U)
    packed.sort()
    order = (packed & U((1 << place) - 1)).astype(short)
    packed >>= U(place)
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    name = np.empty(len(keys), short)
    name[order] = np.cumsum(new, dtype=short) - 1
    packed = packed[new]
    return ((packed >> U(wide)) << U(32)) | (packed & low), name


def repair(ids: np.ndarray, first: int, min_count: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of an id sequence: (rules [n, 2], expansion length of each rule, final symbols).

    ``first`` is the id of the first nonterminal, above all ids.  Rounds go on until no pair occurs ``min_count`` times
    (of a run of one symbol, every second pair counts).
    """
    symbols = ids.astype(np.uint32)
    rules, lengths, following = [np.zeros((0, 2), np.uint32)], [np.zeros(0, np.uint32)], first
    # a pair of symbols that both stand already only loses occurrences: once rare, its places need no further count
    # places are held in 32 bits, work arrays changed in their place: a worker's memory follows the most that stands at once
    short = np.int32 if len(symbols) < 1 << 31 else np.int64
    live = np.arange(max(len(symbols) - 1, 0), dtype=short)
    while len(live):
        keys = symbols[live].astype(U)
        keys <<= U(32)
        keys |= symbols[live + 1]
        # pairs that share a slot are at least as many as each of them: few are left to be counted by sorting
        bits = max(10, min(20, len(live).bit_length()))
        slot = keys * U(0x9E3779B97F4A7C15)
        slot >>= U(64 - bits)
        slot = slot.astype(np.int32)
        often = (np.bincount(slot, minlength=1 << bits) >= min_count)[slot]
        at, keys = live[often], keys[often]
        del live, slot, often
        found, name = numbered(keys, wide=int(symbols.max()).bit_length())
        del keys
        # in a run of one pair with itself every second occurrence is free
        again = np.ones(len(at), bool)
        again[1:] = (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1])
        run = np.arange(len(at), dtype=short)
        run[~again] = 0
        np.maximum.accumulate(run, out=run)
        free = (np.arange(len(at), dtype=short) - run) % 2 == 0
        del again, run
        count = np.bincount(name[free], minlength=len(found))
        frequent = (count >= min_count)[name]
        open_ = at[frequent]
        at, name = at[frequent & free], name[frequent & free]
        if not len(at):
            break
        # where occurrences overlap, the more frequent pair goes first (of equals the first one found)
        rank = np.argsort(np.argsort(-count, kind="stable"), kind="stable").astype(short)[name]
        left = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (rank[1:] >= rank[:-1])])
        right = np.concatenate([(at[1:] == at[:-1] + 1) & (rank[:-1] > rank[1:]), [False]])
        taken = ~(left | right)
        # a rule pays if enough occurrences go at once; those of the most frequent pair all do
        taken &= np.bincount(name[taken], minlength=len(found))[name] >= min_count
        at, name = at[taken], name[taken]
        has = np.bincount(name, minlength=len(found)) > 0
        where, pairs = (np.cumsum(has) - 1)[name], found[has]
        new = np.stack([(pairs >> U(32)).astype(np.uint32), (pairs & U(0xFFFFFFFF)).astype(np.uint32)], 1)
        known, size, inner = np.concatenate(lengths), np.ones(new.shape, np.uint32), new >= first
        size[inner] = known[new[inner] - first]
        rules.append(new)
        lengths.append(size.sum(1, dtype=np.uint32))
        symbols[at] = (where + following).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # places in the shorter sequence: still frequent pairs, and the new symbols' pairs on either side
        place = np.cumsum(keep, dtype=short) - 1
        symbols, following = symbols[keep], following + len(new)
        mark = np.zeros(len(symbols) + 1, bool)
        mark[place[open_]] = True
        mark[place[at]] = True
        mark[place[at] - 1] = True
        live = np.flatnonzero(mark[: len(symbols) - 1]).astype(short)
    return np.concatenate(rules), np.concatenate(lengths), symbols


def pack(ids: np.ndarray, bounds: np.ndarray, first: int) -> bytes:
    """A shard of ``ids``; ``bounds`` are the documents' offsets in it (documents + 1 values)."""
    rules, lengths, symbols = repair(ids, first)
    wide = np.uint16 if first + len(rules) <= 1 << 16 else np.uint32
    size = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    size[inner] = lengths[symbols[inner] - first]
    places = (np.cumsum(size) - size)[::STRIDE]
    head = _HEAD.pack(MAGIC, first, len(rules), len(symbols), len(bounds) - 1, len(ids))
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(wide).tobytes(), places.astype("<u4").tobytes(), bounds.astype("<u8").tobytes()])


class Shard:
    """Reads a shard: all its ids, a document's, or any range of them."""

    def __init__(self, blob: bytes) -> None:
        magic, self.first, n_rules, n_symbols, self.n_docs, self.n_ids = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEAD.size
        self.rules = np.frombuffer(blob, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(blob, "<u4", n_rules, at)
        at += 4 * n_rules
        wide = "<u2" if self.first + n_rules <= 1 << 16 else "<u4"
        self.symbols = np.frombuffer(blob, wide, n_symbols, at)
        at += n_symbols * int(wide[2])
        self.places = np.frombuffer(blob, "<u4", -(-n_symbols // STRIDE), at)
        at += 4 * len(self.places)
        self.bounds = np.frombuffer(blob, "<u8", self.n_docs + 1, at).astype(np.int64)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.first
        out[inner] = self.lengths[symbols[inner] - self.first]
        return out

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Every rule written out, one after another, and where each begins."""
        if self._table is None:
            symbols = np.arange(self.first, self.first + len(self.rules), dtype=np.uint32)
            while (inner := symbols >= self.first).any():
                out = np.empty(len(symbols) + inner.sum(), np.uint32)
                at = np.arange(len(symbols)) + np.concatenate([[0], np.cumsum(inner)[:-1]])
                out[at[~inner]] = symbols[~inner]
                pair = self.rules[symbols[inner] - self.first]
                out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
                symbols = out
            self._table = symbols, np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        return self._table

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.uint32)
        if not len(self.rules):
            return symbols
        flat, begin = self._expansions()
        size = self._sizes(symbols)
        inner = symbols >= self.first
        # terminals are read from a tail of the table, at their own place
        source = np.concatenate([flat, symbols[~inner]])
        start = np.empty(len(symbols), np.int64)
        start[inner] = begin[symbols[inner] - self.first]
        start[~inner] = len(flat) + np.arange(len(symbols) - inner.sum())
        ends = np.cumsum(size)
        return source[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the symbols that cover them."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        if start == 0 and stop == self.n_ids:
            return self._expand(self.symbols)
        # strides that hold the range, then the symbols in them
        p = int(np.searchsorted(self.places, start, "right")) - 1
        q = int(np.searchsorted(self.places, stop, "left"))
        part = self.symbols[p * STRIDE : q * STRIDE]
        ends = np.cumsum(self._sizes(part)) + int(self.places[p])
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[a - 1]) if a else int(self.places[p])
        return self._expand(part[a:b])[start - before : stop - before]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


# --- encoding ------------------------------------------------------------------------------------


def blank_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a span is a blank and then one or more ASCII letters."""
    letters = np.zeros(len(data) + 1, np.int32)
    np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A), out=letters[1:])
    return (data[starts] == 0x20) & (ends - starts > 1) & (letters[ends] - letters[starts + 1] == ends - starts - 1)


_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
_PIECE = counter_hash(0x91ECE, 10) | U(1)
_LONG = 64


class Spans:
    """Byte spans as words of eight bytes, for hashing and for comparing them whole; ``data`` ends in eight spare bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        self.data, self.starts, self.size = data, starts, size
        self.view = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        self.first = self.second = self.over = np.zeros(0, U)

    def word(self, which: np.ndarray | slice, k: int) -> np.ndarray:
        """The k-th eight bytes of spans that have them, zeros beyond their end."""
        return self.view[self.starts[which] + 8 * k] & _LOW_BYTES[np.minimum(self.size[which] - 8 * k, 8)]

    def bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.size[i]].tobytes()

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            self.first = self.view[self.starts]
            self.first &= _LOW_BYTES[np.minimum(self.size, 8)]
            h = self.first * _PIECE[0]
            h += self.size.astype(U) * _PIECE[9]
            self.over = left = np.flatnonzero(self.size > 8)
            self.second = self.word(left, 1)
            h[left] += self.second * _PIECE[1]
            for k in range(2, _LONG // 8):
                left = left[self.size[left] > 8 * k]
                if not len(left):
                    break
                h[left] += self.word(left, k) * _PIECE[k]
            for i in left[self.size[left] > _LONG].tolist():
                h[i] = int.from_bytes(blake2b(self.bytes(i), digest_size=8).digest(), "little")
        return mix64(h)

    def differ(self, first: np.ndarray, second: np.ndarray, other: Spans, theirs: np.ndarray) -> np.ndarray:
        """Which spans are not, byte for byte, the spans ``theirs`` of ``other``, whose first and second words are given."""
        unlike = self.size != other.size[theirs]
        unlike |= self.first != first[theirs]
        unlike[self.over] |= self.second != second[theirs[self.over]]
        left = self.over[(self.size[self.over] > 16) & ~unlike[self.over]]
        for k in range(2, _LONG // 8):
            if not len(left):
                break
            unlike[left] |= self.word(left, k) != other.word(theirs[left], k)
            left = left[self.size[left] > 8 * (k + 1)]
        for i in left.tolist():
            unlike[i] |= self.bytes(i) != other.bytes(theirs[i])
        return np.flatnonzero(unlike)


class PieceEncoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct piece of text once.

    Such a tokenizer first splits a text and merges bytes only inside the parts, so ids of a text are the
    ids of any cutting at places where it splits anyway.  Those used: between a letter and a following
    ASCII punctuation mark, blank or line feed; before a single blank or line feed that stands between
    other characters.  The pieces' bytes and ids are kept in a hash table that grows with them up to a bound, emptied when full.
    A piece found by its hash is compared byte for byte; one whose hash belongs to another piece is encoded by itself.
    """

    MOST = 1_500_000
    SLOTS = 1 << 16

    def __init__(self, tokenizer_path: str) -> None:
        # a task has one core; threads of the library would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        token = self.tokenizer.id_to_token
        self.width = np.array([len(token(i) or "") for i in range(self.vocabulary)], np.int64)  # a character stands for a byte
        self._empty()

    def _empty(self) -> None:
        self._slots(self.SLOTS)
        self.count = self.used = 0
        self.start = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32 if self.vocabulary > 1 << 16 else np.uint16)
        self.text, self.text_at, self.text_used = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.int32), 0
        self.text_size, self.text_first, self.text_second = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, U), np.zeros(1 << 16, U)

    def _slots(self, n: int) -> None:
        self.keys = np.zeros(n, U)
        self.entry = np.full(n, -1, np.int32)

    def _put(self, h: np.ndarray, own: np.ndarray) -> None:
        """Hashes that the table doesn't have, and their entries."""
        slot = (h & U(len(self.keys) - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):  # the first of those that want a free slot gets it
            s = slot[left]
            _, first = np.unique(s, return_index=True)
            win = left[first[self.entry[s[first]] < 0]]
            self.entry[slot[win]], self.keys[slot[win]] = own[win], h[win]
            left = left[self.entry[slot[left]] != own[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    @staticmethod
    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces; every row's start is one, where the row isn't empty."""
        n = len(data)
        plain = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        blank = (data == 0x20) | (data == 0x0A)
        # a whole two-byte character other than U+0080-U+00BF, which holds other white space
        pair = np.zeros(n, bool)
        pair[1:] = (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xCA)
        solid = plain | pair | ((data > 0x20) & (data < 0x7F))
        begins = plain | ((data > 0x20) & (data < 0x7F)) | ((data >= 0xC3) & (data <= 0xCA))
        mark = np.zeros(n, bool)
        single = np.zeros(n, bool)
        single[1:-1] = blank[1:-1] & solid[:-2] & begins[2:]
        mark |= single
        mark[1:] |= single[:-1] & (data[:-1] == 0x0A)
        point = (data > 0x20) & (data < 0x7F) & ~plain & ~((data >= 0x30) & (data <= 0x39))
        mark[1:] |= plain[:-1] & point[1:]
        mark[offsets[:-1][offsets[:-1] < n]] = True
        return np.flatnonzero(mark)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if absent."""
        slot = (h & U(len(self.keys) - 1)).astype(np.int64)
        out = self.entry[slot]
        odd = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & (len(self.keys) - 1)
            out[odd] = self.entry[slot[odd]]
            odd = odd[(out[odd] >= 0) & (self.keys[slot[odd]] != h[odd])]
        return out

    @staticmethod
    def _joined(pieces: list[str], words: int) -> list[str]:
        """The pieces in fewer strings: the first ``words``, each a blank and ASCII letters, are cut apart again by the tokenizer."""
        return ["".join(pieces[i : min(i + 512, words)]) for i in range(0, words, 512)] + pieces[words:]

    def _add(self, h: np.ndarray, first: np.ndarray, second: np.ndarray, pieces: list[str], sizes: np.ndarray, words: int) -> None:
        """Pieces of ``sizes`` bytes, the first and second eight of which are given; the first ``words`` of them may be joined."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(self._joined(pieces, words), add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(got), self.flat.dtype, sum(map(len, got)))
        ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(sizes), "left") + 1
        size = np.diff(ends, prepend=0).astype(np.int32)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(h) > len(self.start):
            grown = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.text_at, self.text_size, self.text_first, self.text_second))
            self.start, self.size, self.text_at, self.text_size, self.text_first, self.text_second = grown
        while self.text_used + int(sizes.sum()) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.flat[self.used : self.used + len(flat)] = flat
        own = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.start[own] = self.used + np.cumsum(size) - size
        self.size[own] = size
        self.text_at[own] = self.text_used + np.cumsum(sizes) - sizes
        self.text_size[own], self.text_first[own], self.text_second[own] = sizes, first, second
        known = np.frombuffer("".join(pieces).encode(), np.uint8)
        self.text[self.text_used : self.text_used + len(known)] = known
        self.text_used += len(known)
        self.used += len(flat)
        self.count += len(h)
        if 2 * self.count > len(self.keys):
            full = np.flatnonzero(self.entry >= 0)
            old, at = self.keys[full], self.entry[full]
            self._slots(1 << (2 * self.count).bit_length())
            self._put(old, at)
        self._put(h, own)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and the rows' offsets in them."""
        data, offsets = string_buffers(column)
        if not len(data):
            return np.zeros(0, self.flat.dtype), np.zeros(len(offsets), np.int64)
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        spans = Spans(np.concatenate([data, np.zeros(8, np.uint8)]), starts, ends - starts)
        h = spans.hashes()
        entry = self._find(h)
        if (missing := np.flatnonzero(entry < 0)).size:
            if self.count + len(missing) > self.MOST and self.count:
                self._empty()
                missing = np.arange(len(h))
            _, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            word = blank_words(data, starts[at], ends[at])
            at = np.concatenate([at[word], at[~word]])
            words, raw = int(word.sum()), data.tobytes()
            second = np.zeros(len(h), U)
            second[spans.over] = spans.second
            for i in range(0, len(at), 4_000):
                part = at[i : i + 4_000]
                a, b = starts[part], ends[part]
                self._add(h[part], spans.first[part], second[part], [raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], b - a, min(max(words - i, 0), len(part)))
            if len(missing) == len(h):
                entry = self._find(h)
            else:
                entry[missing] = self._find(h[missing])
        size = self.size[entry].astype(np.int64)
        done = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[entry] - (done - size), size) + np.arange(done[-1])]
        other = spans.differ(self.text_first, self.text_second, Spans(self.text, self.text_at, self.text_size), entry)
        if len(other):  # another piece has the hash: its ids give way
            cut = np.split(ids, done[:-1])
            for i in other.tolist():
                cut[i] = np.array(self.tokenizer.encode(spans.bytes(i).decode(), add_special_tokens=False).ids, self.flat.dtype)
                size[i] = len(cut[i])
            ids, done = np.concatenate(cut), np.cumsum(size)
        return ids, np.concatenate([[0], done])[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process, which keeps its table from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def release_encoder() -> None:
    """Give the memory of this worker's encoder back to the system: workers live on into other operators."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` bytes of text at least one row each."""
    _, offsets = string_buffers(batch.column(1))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


_SHARDS = "part long, seq long, first_doc_id long, last_doc_id long, n_docs long, n_ids long, doc_ids array<long>, blob binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_ids: int = 1 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order and store the shards; returns their table.

    A shard ends with the document that fills it to ``shard_ids`` ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        ids, docs_in, sizes, n = [], [], [], 0

        def flush():
            nonlocal ids, docs_in, sizes, n, seq
            size = np.concatenate(sizes)
            blob = pack(np.concatenate(ids), np.concatenate([[0], np.cumsum(size)]), enc.vocabulary)
            own = pa.concat_arrays(docs_in)
            row = {"part": part, "seq": seq, "first_doc_id": own[0].as_py(), "last_doc_id": own[-1].as_py(), "n_docs": len(own), "n_ids": int(size.sum())}
            out = pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in row.values()] + [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([blob], pa.binary())],
                names=[*row, "doc_ids", "blob"],
            )
            ids, docs_in, sizes, n, seq = [], [], [], 0, seq + 1
            return out

        for batch in batches:
            for rows in _slices(batch, max(1, shard_ids // 2)):
                got, offsets = enc.encode(rows.column(1))
                with_end, bounds = np.insert(got, offsets[1:], end_id), offsets + np.arange(len(offsets))
                own, i = rows.column(0).cast(pa.int64()), 0
                while i < len(own):
                    # up to the document that fills the shard
                    j = min(len(own), int(np.searchsorted(bounds, bounds[i] + shard_ids - n)))
                    ids.append(with_end[bounds[i] : bounds[j]])
                    docs_in.append(own.slice(i, j - i))
                    sizes.append(np.diff(bounds[i : j + 1]))
                    n += int(bounds[j] - bounds[i])
                    if n >= shard_ids:
                        yield flush()
                    i = j
            del batch, rows
        if n:
            yield flush()
        give_back()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, _SHARDS), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode every document of a shard table: doc_id, start, n_tokens, ids_crc32, part, seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoder()
        for batch in batches:
            for part, seq, own, blob in zip(*(batch.column(i) for i in range(4)), strict=True):
                shard = Shard(blob.as_py())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                b = shard.bounds
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.values, pa.array(b[:-1]), pa.array(np.diff(b)), pa.array(crc, pa.int64()), pa.array(np.full(len(crc), part.as_py())), pa.array(np.full(len(crc), seq.as_py()))],
                    names=["doc_id", "at", "n_tokens", "ids_crc32", "part", "seq"],
                )

    rows = shards.select("part", "seq", "doc_ids", "blob").mapInArrow(sparing(run), "doc_id long, at long, n_tokens long, ids_crc32 long, part long, seq long")
    # ids before each shard: totals of the few parts first, then the shards inside each part
    sizes = shards.select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("part_start"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("shard_start"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as shards and return what reading them back gives for each document."""
    return read_documents(write_shards(docs, tokenizer_path, end_id))
