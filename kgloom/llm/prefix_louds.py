"""Prefix trie of conversations as succinct level-order tries over prefix shards.

A turn is a label of 24 bytes: 16 of the SHA-256 of its role and text, 8 for its number of words.  A conversation is the path of its labels.
Equal paths meet first (a task streams through their members' ids, which are never collected); the distinct paths are then dealt by range in
their order and cut into shards of at most ``SHARD`` paths, so that each shard is a piece of the trie, and a first turn that a third
of all conversations share is spread over as many shards as it needs.

In a shard NumPy builds the trie level by level: a row opens a node where its path leaves that of the row before.  The nodes in that order
are written as LOUDS (for each node a 1 for each child, then a 0), with an array of labels and the counts of the paths that end
there.  Reading a shard takes parents and children from the bits alone (``Louds``); rollups go in reverse breadth-first order, each level added to
its parents by ``add.at``.

Nodes that a shard shares with the one before or after it stand on the path to its first or last row; these heavy upper levels
leave the shard as partial sums, what an earlier shard has counted left out, and merge by aggregation.

Sums that merge: saved tokens of a subtree are those of n * words, over all shards, less those of words, once a node.

Defined cases: rows without ``conv_id`` belong to no conversation; turns go by ``turn``, null first, equal ones by role and the hash
of their text; a null role or text is empty; repeated rows are turns of their own; a conversation without turns ends at the root; a text of
any length is hashed and counted by the JVM; of a conversation the labels stand in one row (24 bytes a turn); an empty table gives no
rows, not even a root; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import sparing, stored

WORD = r"[^\x20\x09-\x0D]+"
LABEL = 24
SHARD, SHARD_BYTES = 1 << 14, 8 << 20
SHARED_TURNS, GROUP = 4, 20


# --- paths -----------------------------------------------------------------------------------------


def conversation_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path: the labels of each conversation's turns in their order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 16, "0")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    label = F.concat(F.substring(digest, 1, 32), words)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("tie"), label.alias("label")).alias("t")
    )
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda x: x["label"])
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("path"))


def shared_heads(paths: DataFrame) -> DataFrame:
    """Paths whose first h labels are those of the conversation that heads their group of ``GROUP`` ids; h by the crc32 of the id.

    Of a head with fewer turns all, of one that is absent none; the conversation's own turns after its first h follow.
    """
    paths = stored(paths, "trie-paths")
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")
    heads = paths.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head"), F.substring("path", 1, LABEL * (SHARED_TURNS - 1)).alias("first"))
    met = paths.withColumn("head", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", h).join(heads, "head", "left")
    led = F.coalesce(F.substring("first", F.lit(1), F.col("h") * LABEL), F.unhex(F.lit("")))
    return met.select("conv_id", F.concat(led, F.expr(f"substring(path, h * {LABEL} + 1)")).alias("path"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, conv_id) in order: each distinct path with its members' count, least id, and the digest of all ids."""
    schema = pa.schema([("path", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.binary())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    here, rows, n, least, seen = None, [], 0, 0, sha256()
    for batch in batches:
        for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if path != here:
                if here is not None:
                    rows.append((here, n, least, seen.digest()))
                    if len(rows) == 1 << 12:
                        yield out(rows)
                        rows = []
                here, n, least, seen = path, 0, conv, sha256()
            seen.update(b",%d" % conv if n else b"%d" % conv)
            n += 1
    if here is not None:
        rows.append((here, n, least, seen.digest()))
    if rows:
        yield out(rows)


def _shards(most: int, most_bytes: int):
    """Number shards in sorted order: ``most`` paths or ``most_bytes`` of labels each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, out = batch.column("shard")[0].as_py() << 32, []
            for n in pc.binary_length(batch.column("path")).to_pylist():
                if rows == most or size > most_bytes:
                    number, rows, size = number + 1, 0, 0
                rows, size = rows + 1, size + n
                out.append(part + number)
            columns = {name: batch.column(name) for name in batch.schema.names} | {"shard": pa.array(out, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


# --- tries -----------------------------------------------------------------------------------------


def shared_labels(a: bytes | None, b: bytes | None) -> int:
    """Labels that two paths begin with alike; -1 if there is no path."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    x, y = (np.frombuffer(v + bytes(LABEL), np.uint8)[:n].reshape(-1, LABEL) for v in (a, b))
    differ = np.flatnonzero((x != y).any(1))
    return int(differ[0]) if len(differ) else len(x)


def build_louds(paths: list[bytes], n: np.ndarray, least: np.ndarray, ends: list[bytes], before: bytes | None, after: bytes | None) -> bytes:
    """Blob of the trie over sorted distinct paths: bits, labels, and what ends at each node.

    ``before`` and ``after`` are the paths next to the shard: how many levels are shared with them is kept too.
    """
    size = np.array([len(p) for p in paths]) // LABEL
    flat = np.frombuffer(b"".join([*paths, bytes(LABEL)]), f"V{LABEL}")
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    # level 0 is the root; rows still on their way, and the node each stands at, by its number among all nodes
    rows, at = np.arange(len(paths)), np.zeros(len(paths), np.int64)
    last = np.zeros(len(paths), np.int64)
    parent, label, count = [np.zeros(1, np.int64)], [np.zeros(1, f"V{LABEL}")], 1
    depth = 0
    while True:
        on = size[rows] > depth
        rows, at = rows[on], at[on]
        if not len(rows):
            break
        mark = flat[start[rows] + depth]
        new = np.ones(len(rows), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1])
        parent.append(at[new])
        label.append(mark[new])
        at = count + np.cumsum(new) - 1
        count += int(new.sum())
        last[rows] = at
        depth += 1
    up = np.concatenate(parent)
    children = np.bincount(up[1:], minlength=count)
    bits = np.ones(2 * count - 1, np.uint8)
    bits[np.cumsum(children) + np.arange(count)] = 0
    head = struct.pack("<qqqq", count, len(paths), shared_labels(before, paths[0]), shared_labels(paths[-1], after))
    order = np.argsort(last)
    parts = [np.packbits(bits).tobytes(), np.concatenate(label)[1:].tobytes(), last[order].astype("<i8").tobytes(), n[order].astype("<i8").tobytes(), least[order].astype("<i8").tobytes()]
    return b"".join([head, *parts, b"".join(ends[i] for i in order.tolist())])


class Louds:
    """A shard's trie, read from its blob: the shape is in the bits alone."""

    def __init__(self, blob: bytes) -> None:
        self.count, rows, self.before, self.after = struct.unpack_from("<qqqq", blob)
        at = 32
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, (2 * self.count + 6) // 8, at), count=2 * self.count - 1).astype(bool)
        at += (2 * self.count + 6) // 8
        self.labels = np.frombuffer(blob, f"V{LABEL}", self.count - 1, at)
        at += LABEL * (self.count - 1)
        self.end_node, self.end_n, self.end_least = (np.frombuffer(blob, "<i8", rows, at + 8 * rows * i) for i in range(3))
        self.end_hash = np.frombuffer(blob, "V32", rows, at + 24 * rows)
        # the k-th 1 is node k (from 1), its parent the number of 0s before it; a node's children are the 1s before its 0
        zeros = np.flatnonzero(~bits)
        self.children = np.diff(np.concatenate([[-1], zeros])) - 1
        self.parent = np.flatnonzero(bits) - np.arange(self.count - 1)
        # ``stop`` is where a node's children end; the children of a level's nodes are the next level
        self.stop, self.levels, low, high = 1 + zeros - np.arange(self.count), [], 0, 1
        while low < high:
            self.levels.append((low, high))
            low, high = high, int(self.stop[high - 1])

    def child(self, node: int, label: bytes) -> int | None:
        """The child of a node by its label."""
        stop = int(self.stop[node])
        for k in range(stop - int(self.children[node]), stop):
            if self.labels[k - 1].tobytes() == label:
                return k
        return None

    def edges(self) -> tuple[list[int], list[int]]:
        """Nodes shared with the shard before (on the path of the first row) and after (on that of the last), from the root down."""
        first, last = [0], [0]
        for low, high in self.levels[1:]:
            if len(first) <= self.before:
                first.append(low)
            if len(last) <= self.after:
                last.append(high - 1)
        return first[: self.before + 1], last[: self.after + 1]

    def rolled(self) -> dict[str, np.ndarray]:
        """Of each node: members, least member, own words, leaves, and subtree sums of members * words and of words.

        What a shard before this one has counted (words and leaves of shared nodes) is left out.
        """
        n, least = np.zeros(self.count, np.int64), np.full(self.count, np.iinfo(np.int64).max)
        n[self.end_node], least[self.end_node] = self.end_n, self.end_least
        words = np.zeros(self.count, np.int64)
        if self.count > 1:
            words[1:] = np.frombuffer(self.labels.tobytes(), ">i8").reshape(-1, LABEL // 8)[:, 2]
        first, last = self.edges()
        leaf = (self.children == 0).astype(np.int64)
        leaf[first] = 0
        leaf[last] = 0  # a node shared with the next shard has children there, or is a parent here
        once = words.copy()
        once[first] = 0
        up = np.concatenate([[0], self.parent])
        for low, high in self.levels[:0:-1]:
            np.add.at(n, up[low:high], n[low:high])
            np.minimum.at(least, up[low:high], least[low:high])
        held = n * words
        for low, high in self.levels[:0:-1]:
            for sums in (leaf, held, once):
                np.add.at(sums, up[low:high], sums[low:high])
        return {"n": n, "least": least, "leaves": leaf, "held": held, "once": once, "up": up}

    def prefixes(self, nodes: list[int]) -> list[bytes]:
        """SHA-256 of the labels down to each of the nodes, which follow one another from the root."""
        seen, out = sha256(), []
        for k in nodes:
            if k:
                seen.update(self.labels[k - 1].tobytes())
            out.append(seen.copy().digest())
        return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, path, n, least, ends) in order, kinds 0 and 1 the paths before and after the shard: a blob a shard."""

    def out(shard: int, c: list[list], sides: list) -> pa.RecordBatch:
        blob = build_louds(c[0], np.array(c[1], np.int64), np.array(c[2], np.int64), c[3], *sides)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    here, columns, sides = None, [[], [], [], []], [None, None]
    for batch in batches:
        names = ("shard", "kind", "path", "n", "least", "ends")
        for shard, kind, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if shard != here:
                if here is not None:
                    yield out(here, columns, sides)
                here, columns, sides = shard, [[], [], [], []], [None, None]
            if kind < 2:
                sides[kind] = row[0]
            else:
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
    if here is not None:
        yield out(here, columns, sides)


def build_tries(paths: DataFrame, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, blob: LOUDS tries over ``paths`` (conv_id, path), in the order of their paths."""
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = paths.repartition("path").sortWithinPartitions("path", "conv_id").select("path", "conv_id").mapInArrow(sparing(_ends), "path binary, n long, least long, ends binary")
    ends = stored(ends, "trie-ends")
    dealt = ends.repartitionByRange("path").sortWithinPartitions("path").select(F.spark_partition_id().cast("long").alias("shard"), "path", "n", "least", "ends")
    dealt = stored(dealt.mapInArrow(_shards(shard, shard_bytes), "shard long, path binary, n long, least long, ends binary"), "trie-shards")
    bounds = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    turn = Window.orderBy("shard")  # a row for each shard
    beside = stored(bounds.select("shard", F.lag("high").over(turn).alias("before"), F.lead("low").over(turn).alias("after")), "trie-bounds")
    none = [F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("binary").alias("ends")]
    rows = [beside.filter(F.col(c).isNotNull()).select("shard", F.lit(k).alias("kind"), F.col(c).alias("path"), *none) for k, c in enumerate(("before", "after"))]
    rows.append(dealt.select("shard", F.lit(2).alias("kind"), "path", "n", "least", "ends"))
    dealt = reduce(DataFrame.unionByName, rows).repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "path")
    return stored(dealt.mapInArrow(sparing(_build), "shard long, blob binary"), "tries")


# --- nodes -----------------------------------------------------------------------------------------

_EDGE = "key binary, parent_key binary, shard long, node long, depth long, n long, least long, children long, leaves long, held long, once long, ends binary"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard the nodes that it shares with others, as partial sums; the root always."""
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _EDGE.split(", ")])
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            t = Louds(blob)
            r, ends = t.rolled(), dict(zip(t.end_node.tolist(), t.end_hash, strict=True))
            first, last = t.edges()
            first = first or [0]
            # children that an earlier shard has too are counted there: a shared node's first child on the way down
            seen = np.zeros(t.count, np.int64)
            seen[r["up"][t.edges()[0][1:]]] = 1
            rows = {}
            for way in (first, last):
                keys = t.prefixes(way)
                for d, k in enumerate(way):
                    end = ends[k].tobytes() if k in ends else None
                    rows[k] = (keys[d], keys[d - 1] if d else None, shard, k, d, int(r["n"][k]), int(r["least"][k]), int(t.children[k] - seen[k]), int(r["leaves"][k]), int(r["held"][k]), int(r["once"][k]), end)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows.values(), strict=True), schema, strict=True)], schema=schema)


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 binary"


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, blob, merged): nodes that a shard has alone; ``merged`` gives the least members of those it shares."""
    for batch in batches:
        for blob, merged in zip(batch.column("blob").to_pylist(), batch.column("merged").to_pylist(), strict=True):
            t = Louds(blob)
            r = t.rolled()
            least, own = r["least"], np.ones(t.count, bool)
            for x in merged:
                least[x["node"]], own[x["node"]] = x["least"], False
            depth = np.zeros(t.count, np.int64)
            for d, (low, high) in enumerate(t.levels):
                depth[low:high] = d
            ends = np.full(t.count, np.frombuffer(sha256().digest(), "V32")[0], "V32")
            ends[t.end_node] = t.end_hash
            k = np.flatnonzero(own)
            for i in range(0, len(k), 1 << 13):
                j = k[i : i + (1 << 13)]
                hashes = pa.array([x.tobytes() for x in ends[j]], pa.binary())
                columns = (least[j], depth[j], least[r["up"][j]], r["n"][j], t.children[j], r["leaves"][j], r["held"][j] - r["once"][j])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), hashes], names=[x.split()[0] for x in _NODE.split(", ")])


def trie_nodes(tries: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node."""
    partial = stored(tries.mapInArrow(sparing(_partial), _EDGE), "trie-edges")
    total = lambda *names: [F.sum(x).alias(x) for x in names]
    merged = partial.groupBy("key").agg(
        F.any_value("parent_key").alias("parent_key"), F.any_value("depth").alias("depth"), F.min("least").alias("least"), F.max("ends").alias("ends"), *total("n", "children", "leaves", "held", "once")
    )
    merged = stored(merged, "trie-merged")
    above = merged.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id"))
    shared = merged.join(above, "parent_key", "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("held") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.unhex(F.sha2(F.lit(""), 256))).alias("ends_sha256"),
    )
    back = partial.select("key", "shard", "node").join(merged.select("key", "least"), "key").groupBy("shard").agg(F.collect_list(F.struct("node", "least")).alias("merged"))
    inner = tries.join(back, "shard").select("blob", "merged").mapInArrow(sparing(_inner), _NODE)
    return inner.unionByName(shared).withColumn("ends_sha256", F.lower(F.hex("ends_sha256")))


def conversation_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """``trie_nodes`` of conversations rebuilt with shared heads."""
    return trie_nodes(build_tries(shared_heads(conversation_paths(turns)), shard))
