"""Near-duplicate groups by MinHash with tensored banding, confirmed on full shingle sets.

Each distinct shingle set is a class, so exact copies never meet.  A class has two collections of ``m`` keys
of ``r`` minhashes each, and ``m * m`` table keys, one for each pair of a key of the first and one of the second:
2 m r minhashes serve tables that would take 2 m m r.  At similarity s a pair shares a table with probability
(1 - (1 - s**r)**m)**2, which is 0.99993 at 0.8 for m = 10, r = 2.

Of each table key the least class is linked to the others (a star, not all pairs).  After the links are
confirmed and grouped, keys that still hold several groups are gone through twice again (of keys with the same
members, one): members of different groups are tested in blocks, and first the nearest pairs, as many as would join the groups, then
all that pass become rows.  Each time two exact bounds come first: sizes, and the bits in which two 1024-bit images of the sets differ, which is at most what the
sets differ in.  What passes is confirmed by intersecting the full sets.

Defined cases: null text, or one without words, has no set and stays alone; fewer words than a shingle are one
shingle; a class's doc_id is its least, null doc_id after all others; rows with equal doc_id are rows of their
own, and rows of one text share a component; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NON_SPACE, U, counter_hash, gram_hashes, mix64, slices, word_slices
from .components import components
from .shared import fresh, sparing, stored

#: Rows that are sent to every task, and so pass through the driver; of more ids a bitmap of at most 2**CELLS bits is sent, and
#: documents to drop are joined by a shuffle.
MAX_SENT = 1 << 16
CELLS = 26
BITS = 16  # 64-bit words of a set's image
BLOCK = 2048  # members of a key that a task tests against as many


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Each row's distinct ``k``-word shingles, ascending; fewer words are one shingle, none are none."""
    for h, rows in word_slices(column, NON_SPACE):
        grams = gram_hashes(h, k)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            yield np.unique(grams[a : b - k + 1]) if b - a >= k else gram_hashes(h[a:b], b - a) if b > a else np.zeros(0, U)


class Tensored:
    """Two collections of ``m`` keys of ``r`` minhashes; a table key is a pair of one of each."""

    def __init__(self, m: int, r: int) -> None:
        self.m, self.r = m, r
        self.c = counter_hash(0x7E45, 2 * m * r) | U(1)
        self.x = counter_hash(0x11D5, 2 * m * r)

    def keys(self, s: np.ndarray) -> np.ndarray:
        low = np.empty(len(self.c), U)
        for i in range(len(low)):
            low[i] = ((s ^ self.x[i]) * self.c[i]).min()
        out = np.zeros(2 * self.m, U)
        for j in range(self.r):
            out = mix64(out ^ low[j :: self.r])
        return out


def set_id(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    t = mix64(s ^ U(0x51A7))
    return np.array([mix64(s.sum(dtype=U)[None])[0] ^ U(len(s)), np.bitwise_xor.reduce(t) ^ t.sum(dtype=U)], U).tobytes()


def image(s: np.ndarray) -> np.ndarray:
    """Parity of the set's members in each of 64 * BITS cells."""
    cell = np.bincount((s >> U(20)).astype(np.int64) & (64 * BITS - 1), minlength=64 * BITS) & 1
    return np.packbits(cell.astype(np.uint8), bitorder="little").view(np.int64)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which images (rows of 64-bit words) differ; of a signed word NumPy would count those of its absolute value."""
    return np.bitwise_count((a ^ b).view(U)).sum(-1, dtype=np.int64)


def _fixed(rows: list[np.ndarray], n: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * n, pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, k: int, m: int, r: int) -> DataFrame:
    """doc_id, text_hash, n (set size), cid (of the set), keys (2 m), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, none = Tensored(m, r), np.zeros(2 * m, U)
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):  # signatures go out slice by slice
                rows = batch.slice(start, len(part))
                start += len(part)
                n, cid, keys, bits = [], [], [], []
                for s in shingle_sets(part, k):
                    n.append(len(s))
                    cid.append(set_id(s))
                    keys.append(tables.keys(s) if len(s) else none)
                    bits.append(image(s))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), _fixed(keys, 2 * m), _fixed(bits, BITS)], names=["doc_id", "text_hash", "n", "cid", "keys", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sparing(run), "doc_id long, text_hash long, n long, cid binary, keys array<long>, bits array<long>")


def _may_link(n: str, o: str, x: str, y: str, num: int, den: int) -> Column:
    """Exact: false only where 100 * intersection < 80 * union (for num / den = 80 / 100)."""
    n_, o_ = F.col(n), F.col(o)
    differ = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, BITS)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    return (den * F.least(n_, o_) >= num * F.greatest(n_, o_)) & (differ * (den + num) <= (den - num) * (n_ + o_))


def _maybe(ids: DataFrame, n: int) -> tuple[bytes, int]:
    """A bitmap of the hashes ``h`` of ``ids``, some 16 cells for each of the ``n`` up to 2**CELLS in all, and 64 less its number of address bits."""
    cells = min(CELLS, max(6, (16 * n).bit_length()))
    place = F.shiftrightunsigned("h", 64 - cells)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - cells}) & 63 as int))")
    words = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("mask")).toArrow()
    table = np.zeros(1 << (cells - 6), np.int64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy()
    return table.tobytes(), 64 - cells


def _confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    pairs = stored(pairs, "near-pairs")
    own = stored(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct().hint("merge"), "c", "left_semi").select("c", "cid", F.col("doc_id").alias("first"), F.xxhash64("doc_id").alias("h")), "near-own")
    # the document of each class, by id; of more than a few ids a bitmap, which lets others through that the join below leaves out
    texts, n = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text"), own.count()
    sent = shift = None
    if n <= MAX_SENT:
        wanted = F.broadcast(own.select("first").distinct())
        texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    else:
        table, shift = _maybe(own.select("h"), n)
        sent = docs.sparkSession.sparkContext.broadcast(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent is not None:
                place = batch.column("h").to_numpy().view(U) >> U(shift)
                table = np.frombuffer(sent.value, U)
                batch = batch.filter(pa.array((table[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) > 0))
            start = 0
            for part in slices(batch.column("text")):
                found = list(shingle_sets(part, k))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(part)), pa.array(map(set_id, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "cid", "members"])
                start += len(part)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    read = texts.mapInArrow(sparing(sets), "doc_id long, cid binary, members binary").alias("r").join(own.alias("o"), (F.col("r.cid") == F.col("o.cid")) & F.col("doc_id").eqNullSafe(F.col("first")))
    found = stored(read.select("c", "members"), "near-sets")
    left = pairs.join(found.select(F.col("c").alias("a"), F.col("members").alias("x")), "a")
    whole = left.join(found.select(F.col("c").alias("b"), F.col("members").alias("y")), "b")
    return stored(whole.select("a", "b", "x", "y").mapInArrow(sparing(similar), "a long, b long").distinct(), "near-links")


def _met(members: DataFrame) -> DataFrame:
    """Members (key, c, g, n, bits) of keys in the cells (i, j) of blocks that meet, with the block ``own`` that each is of.

    Members of a key are dealt into blocks of about ``BLOCK``.  Those of its largest group have blocks of their own, after the
    others', which do not meet each other: a large group goes once to each block of the rest.
    """
    groups = members.groupBy("key", "g").agg(F.count(F.lit(1)).alias("size"))
    sizes = groups.groupBy("key").agg(F.max(F.struct("size", "g")).alias("top"), F.sum("size").alias("all"))
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    sizes = sizes.select("key", F.col("top.g").alias("top"), blocks(F.col("top.size")).alias("tops"), blocks(F.col("all") - F.col("top.size")).alias("others"))
    at, top = F.xxhash64("c"), F.col("g") == F.col("top")
    own = F.when(top, F.col("others") + F.pmod(at, F.col("tops"))).otherwise(F.pmod(at, F.col("others"))).cast("int")
    last = F.when(top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    # members' images repeat, so their files are a small part of their rows, and Spark would send them all through the driver
    dealt = members.hint("merge").join(sizes.hint("merge"), "key").withColumn("own", own).withColumn("last", last)
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return met.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "c", "g", "n", "bits")


def _nearest(c: np.ndarray, g: np.ndarray, n: np.ndarray, bits: np.ndarray, left: int, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the first ``left`` members and the ``right`` ones that pass both exact bounds: of each first one's in turn the nearest, if
    no pairs before join their groups."""
    g, found = g.copy(), []
    for x in range(left):
        y = right[(g[right] != g[x]) & (den * np.minimum(n[x], n[right]) >= num * np.maximum(n[x], n[right]))]
        differ = unlike(bits[x], bits[y])
        ok = differ * (den + num) <= (den - num) * (n[x] + n[y])
        y, share = y[ok], differ[ok] / (n[x] + n[y[ok]])
        while len(y):
            to = y[share.argmin()]
            found.append((c[x], c[to]))
            g[g == g[to]] = g[x]
            y, share = y[(apart := g[y] != g[x])], share[apart]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _tested(members: DataFrame, num: int, den: int, nearest: bool = False) -> DataFrame:
    """The pairs (a, b) of members (key, c, g, n, bits) of a key, of different groups, that pass both exact bounds.

    A task tests one block against one block, so the pairs of a frequent key spread over tasks and none but those that pass
    become rows.  If ``nearest``, only as many as would join the groups in each pair of blocks.
    """
    rows = _met(stored(members, "near-open"))
    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "c")

    def pairs(c: np.ndarray, g: np.ndarray, n: np.ndarray, bits: np.ndarray, own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        cut = int(np.searchsorted(own, i, "right"))
        left, right = np.arange(cut), np.arange(len(c)) if i == j else np.arange(cut, len(c))
        if nearest:
            return _nearest(c, g, n, bits, cut, right, num, den)
        out = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 64):
            p = left[at : at + 64, None]
            small, large = np.minimum(n[p], n[right]), np.maximum(n[p], n[right])
            may = (g[p] != g[right]) & (den * small >= num * large)
            if i == j:
                may &= p < right
            x, y = np.nonzero(may)
            for s in range(0, len(x), 1 << 16):  # images of some pairs at a time
                a, b = p[x[s : s + (1 << 16)], 0], right[y[s : s + (1 << 16)]]
                differ = unlike(bits[a], bits[b])
                ok = differ * (den + num) <= (den - num) * (n[a] + n[b])
                out.append(np.stack([c[a[ok]], c[b[ok]]]))
        return tuple(np.concatenate(out, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _and_none(batches):
            if batch is not None:
                now = [batch.column(x).to_numpy() for x in ("key", "i", "j", "own", "c", "g", "n")]
                now.append(batch.column("bits").flatten().to_numpy().reshape(-1, BITS))
                rest = now if rest is None else [np.concatenate(v) for v in zip(rest, now, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            key, i, j, own, c, g, n, bits = rest
            begin = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            stops = np.append(begin[1:], len(key))
            full = len(begin) if batch is None else len(begin) - 1
            found = [pairs(c[a:b], g[a:b], n[a:b], bits[a:b], own[a:b], int(i[a]), int(j[a])) for a, b in zip(begin[:full].tolist(), stops[:full].tolist(), strict=True)]
            rest = [v[begin[-1] :] for v in rest]
            x, y = (np.concatenate([np.zeros(0, np.int64), *(f[s] for f in found)]) for s in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return cells.mapInArrow(sparing(run), "a long, b long").distinct()


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _repeated(classes: DataFrame, m: int) -> DataFrame:
    """key, c, least: the classes of each table key that has several, and the least of them."""
    first, second = F.slice("keys", 1, m), F.slice("keys", m + 1, m)
    table = classes.select("c", F.posexplode(first).alias("i", "x"), second.alias("rest")).select("c", "i", "x", F.posexplode("rest").alias("j", "y"))
    keyed = table.select("c", F.xxhash64("i", "x", "j", "y").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # m * m rows of each class, which Spark takes for one and would send through the driver
    return keyed.join(shared.select("key", "least").hint("merge"), "key")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, m: int = 10, r: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (of the shingle set), n_links (of the class), text_hash: a row for each row of ``docs``."""
    signed = stored(signatures(docs, k, m, r), "near-signatures")
    # any row of a class has the same keys and bits
    grouped = signed.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"))
    shapes = signed.filter("n > 0").groupBy("cid").agg(F.any_value(F.struct("keys", "bits")).alias("s")).select("cid", "s.keys", "s.bits")
    # classes are told apart by 128 bits, and numbered for the links
    classes = stored(grouped.join(shapes, "cid").withColumn("c", F.monotonically_increasing_id()), "near-classes")

    hits = stored(_repeated(classes, m), "near-hits")

    shape = classes.select("c", "n", "bits").hint("merge")  # its arrays are larger than Spark takes them for
    stars = hits.filter("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b")).distinct()
    sized = stars.join(shape.select(F.col("c").alias("a"), "n", F.col("bits").alias("x")).hint("merge"), "a").join(shape.select(F.col("c").alias("b"), F.col("n").alias("o"), F.col("bits").alias("y")).hint("merge"), "b")
    links = _confirm(docs, sized.filter(_may_link("n", "o", "x", "y", num, den)).select("a", "b"), classes, k, num, den)
    roots = components(links)

    # keys that hold more than one group, one of those with the same members, and in it pairs of different groups: first the nearest
    # ones, as those that are confirmed make most others needless, then each pair of groups that are still apart
    member = F.xxhash64("c")
    for nearest in (True, False):
        grown = hits.join(roots.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("root", "c").alias("g"))
        open_ = grown.groupBy("key").agg(F.min("g").alias("p"), F.max("g").alias("q"), F.bit_xor(member).alias("f0"), F.sum(F.shiftright(member, 24)).alias("f1"), F.count(F.lit(1)).alias("size"))
        one = open_.filter("p <> q").groupBy("f0", "f1", "size").agg(F.min("key").alias("key")).select("key")
        kept = grown.join(one, "key", "left_semi")
        more = _confirm(docs, _tested(kept.join(shape, "c"), num, den, nearest), classes, k, num, den)
        links = links.unionByName(more)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    number = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.select("cid", "c", "doc_id").join(roots.withColumnRenamed("node", "c").hint("merge"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least.hint("merge"), "root").join(number.hint("merge"), "c", "left").select("cid", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = signed.select("doc_id", "text_hash", "n", "cid").join(known.hint("merge"), "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.hex("cid").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "text_hash")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id; of rows equal in id and text, one."""
    found = stored(near_duplicates(docs, **settings).select("doc_id", "text_hash", "kept"), "near-kept")
    keys = fresh(docs, "near_id", "near_null", "near_text")
    own = fresh(docs, "odd_id", "odd_null", "odd_text", "odd_kept")
    marks = found.groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("c"))
    values = F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.col("text_hash"), F.col("kept")
    odd = stored(marks.filter("not kept or c > 1").select(*(v.alias(n) for v, n in zip(values, own, strict=True))), "near-odd")
    small = odd.count() <= MAX_SENT
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("doc_id").isNull(), F.xxhash64("text")
    named = docs.select("*", *(v.alias(n) for v, n in zip(key, keys, strict=True)))
    same = [F.col(k) == F.col(o) for k, o in zip(keys, own, strict=False)]
    once = named.join(F.broadcast(odd) if small else odd, same, "left_anti").select(*docs.columns)
    again = odd.filter(own[3])
    if not again.isEmpty():
        repeated = named.join(F.broadcast(again) if small else again, same, "left_semi").dropDuplicates(keys)
        once = once.unionByName(repeated.select(*docs.columns))
    return once
