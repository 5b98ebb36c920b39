"""Merkle manifest of a dataset by mountain-range stacks over indexed partitions.

Leaves are dealt by range in (group, key) order and cut into units of at most ``UNIT`` rows; counts of the units give each leaf its place in
its group.  A task walks a unit with a stack for each level: whenever a run of ``FANOUT`` nodes is complete (or the group's last,
shorter run: nothing is padded), the run is hashed and carried up as one node, which may complete the next run.  Nodes whose run
reaches over the unit's edge are peaks that stay; they alone are merged, by the same walk over blocks of ``FANOUT``^8 leaves and then
over groups.  The roots of the groups are the leaves of one more tree, built level by level by grouping.

A proof needs, beside its own unit, only peaks and merged nodes of the runs that cross the unit's two edges: some fourteen a level.
They are looked up by join and sent to the unit's task, which folds every leaf up to the root.

A leaf is H (lower-case hex SHA-256) of its fields, each ``-`` if null, else byte count, ``:`` and value.

Defined cases: nulls have a field mark of their own; a null group is the first group, an empty string the next; null keys come
first; rows of equal key are ordered by their leaf, so that equal rows may change places; a text of any length is hashed by the
JVM and never leaves its row; an empty table gives no rows and no root; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import UPPER, sparing, stored

BITS = 3
FANOUT = 1 << BITS
UNIT = 1 << 14
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(_field(f.cast("string")) for f in fields)), 256)


def size_at(n: int, level: int) -> int:
    """Nodes of a level above ``n`` leaves."""
    return -(-n >> (BITS * level)) if n >= 0 else 0


def height(n: int) -> int:
    """Levels above the leaves."""
    h = 0
    while size_at(n, h) > 1:
        h += 1
    return h


# --- places ----------------------------------------------------------------------------------------


def _units(most: int):
    """Number rows in sorted order: ``unit`` (task and running number) of at most ``most`` rows, and ``rank`` in the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("unit")[0].as_py() << 32
                place = range(done, done + batch.num_rows)
                done += batch.num_rows
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns |= {"unit": pa.array([part + p // most for p in place], pa.int64()), "rank": pa.array([p % most for p in place], pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def placed(rows: DataFrame, order: list[str], name: str, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a column ``g``, the group, and others) with ``unit`` and ``rank``; and for each unit and group ``start``, ``shift``, ``m`` and ``n``.

    ``start`` is the place in the group of the first row of both, ``shift`` what to add to ranks for places, ``m`` their rows, ``n`` those
    of the whole group.  One row a unit and group is all that meets in the window.
    """
    keys = ["g", *order]
    made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().cast("long").alias("unit"), F.lit(0).cast("long").alias("rank"))
    found = stored(made.mapInArrow(_units(unit), made.schema), name)
    counts = found.groupBy("unit", "g").agg(F.count(F.lit(1)).alias("m"), F.min("rank").alias("low"))
    own = Window.partitionBy("g")
    before = F.sum("m").over(own.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0).cast("long"))
    return found, stored(counts.select("unit", "g", start.alias("start"), (start - F.col("low")).alias("shift"), "m", F.sum("m").over(own).alias("n")), f"{name}-places")


# --- the walk --------------------------------------------------------------------------------------

_NODE = "g string, n long, level int, idx long, digest string, peak boolean"


class Range:
    """Stacks of a group's nodes, which come in the order of their leaves.

    ``made`` has each node that is hashed here, and as peaks those that came or were made but whose run is not whole here.
    """

    def __init__(self, n: int) -> None:
        self.n, self.top = n, height(n)
        self.open: list[list[tuple[int, str]]] = [[] for _ in range(self.top + 1)]
        self.made: list[tuple[int, int, str, bool]] = []

    def _leave(self, level: int) -> None:
        self.made += [(level, i, d, True) for i, d in self.open[level]]
        self.open[level] = []

    def push(self, level: int, idx: int, digest: str) -> None:
        while level < self.top:
            run = self.open[level]
            if run and run[0][0] >> BITS != idx >> BITS:
                self._leave(level)
                run = self.open[level]
            run.append((idx, digest))
            if idx % FANOUT != FANOUT - 1 and idx + 1 != size_at(self.n, level):
                return
            if run[0][0] % FANOUT or len(run) != idx % FANOUT + 1:
                self._leave(level)
                return
            self.open[level] = []
            digest, level, idx = _h("".join(d for _, d in run)), level + 1, idx >> BITS
            self.made.append((level, idx, digest, False))
        if not self.top:
            self.made.append((0, idx, digest, True))

    def close(self) -> None:
        for level in range(self.top):
            self._leave(level)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, g, n, level, idx, digest) in the order of their leaves: nodes made and peaks left of each block's groups."""

    def out(g: str, r: Range) -> pa.RecordBatch:
        made, r.made = r.made, []
        return pa.RecordBatch.from_arrays([
            pa.array([g] * len(made), pa.string()), pa.array([r.n] * len(made), pa.int64()), pa.array([x[0] for x in made], pa.int32()),
            pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.string()), pa.array([x[3] for x in made], pa.bool_()),
        ], names=["g", "n", "level", "idx", "digest", "peak"])

    here, now = None, None
    for batch in batches:
        for block, g, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("block", "g", "n", "level", "idx", "digest")), strict=True):
            if (block, g) != here:
                if now is not None:
                    now.close()
                    yield out(here[1], now)
                here, now = (block, g), Range(n)
            now.push(level, idx, digest)
            if len(now.made) > 1 << 14:
                yield out(g, now)
    if now is not None:
        now.close()
        yield out(here[1], now)


def _tasks(df: DataFrame) -> int:
    """Small rows that take long: adaptive execution would put them into too few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _walked(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """The walk over rows (g, n, level, idx, digest), all of a block in one task."""
    first = F.expr(f"shiftleft(idx, {BITS} * level)")
    dealt = rows.select(block.alias("block"), "g", "n", "level", "idx", "digest", first.alias("first")).repartition(_tasks(rows), "block", "g").sortWithinPartitions("block", "g", "first")
    return stored(dealt.drop("first").mapInArrow(sparing(_walk), _NODE), name)


# --- the manifest ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """What a dataset's tree is made of.

    leaves: the rows with unit, rank, g and digest; places: start, shift, m and n of each unit and group; nodes (g, n, level, idx, digest): all
    above the leaves; edges: peaks and merged nodes; roots (g, digest): of the groups; paths (g, level, before, after): siblings above
    them; root: of all, None of an empty dataset.
    """

    leaves: DataFrame
    places: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    paths: DataFrame
    root: str | None


def _top(roots: DataFrame) -> tuple[DataFrame, str | None]:
    """Siblings of the groups' roots on their way to the root of all, and that root."""
    found, places = placed(roots.select(F.lit("").alias("g"), F.col("g").alias("own"), "digest"), ["own"], "merkle-tops")
    first = stored(found.join(places, ["unit", "g"]).select("own", (F.col("shift") + F.col("rank")).alias("idx"), "digest"), "merkle-top")
    n, now, paths = first.count(), first.select("idx", "digest"), []
    for level in range(height(n)):
        runs = now.groupBy(F.shiftright("idx", BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        at = F.shiftright("idx", BITS * level)
        met = first.select("own", at.alias("i"), F.shiftright(at, BITS).alias("run")).join(runs, "run")
        before = F.transform(F.filter("kids", lambda x: x["idx"] < F.col("i")), lambda x: x["digest"])
        after = F.transform(F.filter("kids", lambda x: x["idx"] > F.col("i")), lambda x: x["digest"])
        paths.append(met.select(F.col("own").alias("g"), F.lit(level).alias("level"), F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))
        now = stored(runs.select(F.col("run").alias("idx"), F.sha2(F.array_join(F.transform("kids", lambda x: x["digest"]), ""), 256).alias("digest")), "merkle-top")
    none = roots.sparkSession.createDataFrame([], "g string, level int, before string, after string")
    return reduce(DataFrame.unionByName, paths, none), now.first()["digest"] if n else None


def build_manifest(rows: DataFrame, order: list[str], unit: int = UNIT) -> Manifest:
    """The tree over ``rows``: columns ``g`` (group, no nulls), ``digest`` (leaf), those of ``order``, and any others."""
    leaves, places = placed(rows, order, "merkle-leaves", unit)
    located = leaves.join(places, ["unit", "g"]).select("unit", "g", "n", F.lit(0).alias("level"), (F.col("shift") + F.col("rank")).alias("idx"), "digest")
    own = _walked(located, F.col("unit"), "merkle-units")
    block = F.shiftright(F.expr(f"shiftleft(idx, {BITS} * level)"), 8 * BITS)
    near = _walked(own.filter("peak"), block, "merkle-blocks")
    far = _walked(near.filter("peak"), F.lit(0).cast("long"), "merkle-groups")
    merged = near.filter("not peak").unionByName(far.filter("not peak"))
    nodes = own.filter("not peak").unionByName(merged).drop("peak")
    edges = own.filter("peak").unionByName(merged).drop("peak")
    # a group's root is its one node on the level where a single one is left
    above = F.expr(f"shiftright(n - 1, {BITS} * level) = 0 and (level = 0 or shiftright(n - 1, {BITS} * (level - 1)) > 0)")
    roots = stored(nodes.filter(above).unionByName(edges.filter("n = 1")).select("g", "digest"), "merkle-roots")
    return Manifest(leaves, places, nodes, edges, roots, *_top(roots))


# --- proofs ----------------------------------------------------------------------------------------


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, g, start, m, n): the nodes beside the unit's own ones in runs over its edges."""
    for batch in batches:
        out: list[tuple] = []
        for unit, g, a, m, n in zip(*(batch.column(c).to_pylist() for c in ("unit", "g", "start", "m", "n")), strict=True):
            last = a + m - 1
            for level in range(height(n)):
                low, high = a >> BITS * level, last >> BITS * level
                left = range(low >> BITS << BITS, low)
                right = range(high + 1, min((high >> BITS << BITS) + FANOUT, size_at(n, level)))
                out += [(unit, g, n, level, i) for i in (*left, *right)]
        unit, g, n, level, idx = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(unit, pa.int64()), pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())], names=["unit", "g", "n", "level", "idx"]
        )


_BESIDE, _ABOVE, _LEAF = 0, 1, 2
_PROOF = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


class _Unit:
    """A unit's leaves of one group, what stands beside them, and the way above the group."""

    def __init__(self, n: int) -> None:
        self.n, self.top = n, height(n)
        self.known: list[dict[int, str]] = [{} for _ in range(self.top + 1)]
        self.above: list[tuple[str, str]] = []
        self.leaves: list[tuple[int, int | None, str, str | None]] = []

    def _run(self, level: int, run: int) -> list[str]:
        known = self.known[level]
        return [known[i] for i in range(run << BITS, min((run + 1) << BITS, size_at(self.n, level)))]

    def proofs(self) -> Iterator[tuple[int | None, str, str, str, str]]:
        for place, _, leaf, _ in self.leaves:
            self.known[0][place] = leaf
        first, last = self.leaves[0][0], self.leaves[-1][0]
        for level in range(self.top):
            for run in range(first >> BITS * (level + 1), (last >> BITS * (level + 1)) + 1):
                self.known[level + 1][run] = _h("".join(self._run(level, run)))
        subroot = self.known[self.top][0]
        over = "".join(a + b for a, b in self.above)
        # siblings of the current leaf's ancestors, level by level, and what is read above each level
        at: list[int] = [-1] * (self.top + 1)
        sides: list[tuple[str, str]] = [("", "")] * self.top
        rest = [over] * (self.top + 1)
        for place, doc, leaf, changed in self.leaves:
            for level in range(self.top - 1, 0, -1):
                i = place >> BITS * level
                if at[level] != i:
                    run = self._run(level, i >> BITS)
                    k = i % FANOUT
                    at[level], sides[level] = i, ("".join(run[:k]), "".join(run[k + 1 :]))
                    rest[level] = sides[level][0] + sides[level][1] + rest[level + 1]
            if self.top:
                if at[0] != place >> BITS:
                    at[0], run0 = place >> BITS, self._run(0, place >> BITS)
                k = place % FANOUT
                sides[0] = "".join(run0[:k]), "".join(run0[k + 1 :])
                proof = sides[0][0] + sides[0][1] + rest[1]
            else:
                proof = over
            folded = leaf if changed is None else changed
            for a, b in sides:
                folded = _h(a + folded + b)
            for a, b in self.above:
                folded = _h(a + folded + b)
            yield doc, leaf, subroot, _h(proof), folded


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    names = ("doc_id", "leaf", "subroot", "proof_sha256", "folded_root")

    def out(unit: _Unit) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in unit.proofs() if unit.leaves else ():
            rows.append(row)
            if len(rows) == 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    here, now = None, None
    for batch in batches:
        for unit, g, kind, n, level, idx, a, b, doc in zip(*(batch.column(c).to_pylist() for c in ("unit", "g", "kind", "n", "level", "idx", "a", "b", "doc")), strict=True):
            if (unit, g) != here:
                if now is not None:
                    yield from out(now)
                here, now = (unit, g), _Unit(n)
            if kind == _BESIDE:
                now.known[level][idx] = a
            elif kind == _ABOVE:
                now.above.append((a, b))
            else:
                now.leaves.append((idx, doc, a, b))
    if now is not None:
        yield from out(now)


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of each leaf (columns ``doc_id`` and ``changed`` of the manifest's rows).

    folded_root is folded from ``changed`` (where null: the leaf) and the leaf's siblings.
    """
    none = F.lit(None)
    asked = m.places.mapInArrow(_asked, "unit long, g string, n long, level int, idx long")
    beside = asked.join(m.edges.select("g", "level", "idx", "digest"), ["g", "level", "idx"]).select(
        "unit", "g", F.lit(_BESIDE).alias("kind"), "n", "level", "idx", F.col("digest").alias("a"), none.cast("string").alias("b"), none.cast("long").alias("doc")
    )
    above = m.places.select("unit", "g", "n").join(m.paths, "g").select(
        "unit", "g", F.lit(_ABOVE).alias("kind"), "n", "level", F.lit(0).cast("long").alias("idx"), F.col("before").alias("a"), F.col("after").alias("b"), none.cast("long").alias("doc")
    )
    own = m.leaves.join(m.places, ["unit", "g"]).select(
        "unit", "g", F.lit(_LEAF).alias("kind"), "n", F.lit(0).alias("level"), (F.col("shift") + F.col("rank")).alias("idx"), F.col("digest").alias("a"), F.col("changed").alias("b"), F.col("doc_id").alias("doc")
    )
    dealt = own.unionByName(beside).unionByName(above).repartition(_tasks(own), "unit").sortWithinPartitions("unit", "g", "kind", "level", "idx")
    return dealt.mapInArrow(sparing(_prove), _PROOF).select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), "proof_sha256", "folded_root")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents: group, digest, and where ``tampered`` the digest with A-Z of the text in lower case."""
    fields = [F.col(c) for c in _FIELDS]
    lowered = [*fields[:-1], F.translate("text", UPPER, UPPER.lower())]
    group = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), group.alias("g"), leaf_hash(fields).alias("digest"),
            F.when(tampered, leaf_hash(lowered)).alias("changed"), F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-hashes",
    )


def document_proofs(docs: DataFrame, tampered: Column, unit: int = UNIT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``; groups are languages."""
    found = proofs(build_manifest(document_leaves(docs, tampered), ["doc_id", "digest", "row"], unit))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
