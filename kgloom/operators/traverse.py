"""Neighbourhoods and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import KG, stored
from .read import direction_of, need
from .write import number

MAX_DEPTH = 16
MAX_ENTITIES = 500_000
MAX_EDGES = 2_000_000


def _steps(relations: DataFrame, way: str) -> DataFrame:
    """Edges as steps (here, there, from_id, to_id, type) in the allowed directions."""
    parts = []
    if way != "in":
        parts.append(relations.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "from_id", "to_id", "type"))
    if way != "out":
        parts.append(relations.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "from_id", "to_id", "type"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _steps_of(kg: KG, ids: list[int], way: str) -> DataFrame:
    """``_steps`` from a few nodes, of a graph with a layout: each direction reads the files sorted by its end."""
    parts = []
    if way != "in":
        parts.append(kg.leaving(ids).select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "from_id", "to_id", "type"))
    if way != "out":
        parts.append(kg.entering(ids).select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "from_id", "to_id", "type"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def expand(kg: KG, seeds: DataFrame, depth: int, direction: str = "BOTH", relation_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids within ``depth`` steps of ``seeds`` (id) with their distance, and the relations seen on the way.

    Level by level: a relation is seen when one of its ends is expanded.  From the second level on each frontier is
    written to the shared folder, so plans stay short and a lost executor costs a level.  A frontier of few nodes reads
    their relations alone where the graph has a layout.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    relations = kg.relations.filter(F.col("type") == relation_type) if relation_type else kg.relations
    way = direction_of(direction)
    steps = _steps(relations, way)
    visited = seeds.select("id", F.lit(0).alias("dist"))
    frontier, seen = seeds.select("id"), None
    for hop in range(1, depth + 1):
        ids = kg.few(frontier)
        if ids is not None:
            taken = _steps_of(kg, ids, way)
            taken = taken.filter(F.col("type") == relation_type) if relation_type else taken
        else:
            taken = steps.join(frontier.withColumnRenamed("id", "here"), "here")
        if hop > 1 or kg.layout is not None:
            taken = stored(taken, "hop")
        edges = taken.select("from_id", "to_id", "type")
        seen = edges if seen is None else seen.unionByName(edges)
        frontier = taken.select(F.col("there").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        if hop < depth:
            frontier = stored(frontier, "frontier")
        visited = visited.unionByName(frontier.select("id", F.lit(hop).alias("dist")))
        if hop < depth and (frontier.isEmpty() or visited.count() > MAX_ENTITIES or seen.count() > MAX_EDGES):
            break
    none = kg.relations.limit(0).select("from_id", "to_id", "type")
    return visited, none if seen is None else seen.distinct()


def _shown(kg: KG, ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with names; all ends of the edges are among the ids."""
    few = kg.few(ids)
    return kg.name_of(few).join(ids, "id").select("id", "name", "type", "dist"), kg.edges(edges, few)


def get_neighbors(kg: KG, name: str, direction: str = "BOTH", relation_type: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Entities within ``depth`` (the start among them) and relations seen."""
    return _shown(kg, *expand(kg, kg.chosen([name])[0].select("id"), depth, direction, relation_type))


def extract_subgraph(kg: KG, names: Sequence[str], depth: int = 1) -> tuple[DataFrame, DataFrame]:
    return _shown(kg, *expand(kg, kg.chosen(names)[0].select("id"), depth))


def ui_expand(kg: KG, name: str, direction: str = "both", depth: int = 1) -> tuple[DataFrame, DataFrame]:
    return get_neighbors(kg, name, direction, None, max(1, min(3, depth)))


def _named(kg: KG, paths: DataFrame) -> DataFrame:
    """path_id, pos, name of paths (path_id, path of ids)."""
    flat = paths.select("path_id", F.posexplode("path").alias("pos", "id"))
    few = kg.few(flat) if kg.layout is not None else None
    return flat.join(kg.name_of(few).select("id", "name"), "id").select("path_id", "pos", "name").orderBy("path_id", "pos")


def _next(kg: KG, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Neighbours (id) of nodes (id) in either direction."""
    ids = kg.few(nodes)
    rows = _steps_of(kg, ids, "both") if ids is not None else steps.join(nodes.withColumnRenamed("id", "here"), "here")
    return rows.filter("here <> there").select(F.col("there").alias("id")).distinct()


def find_path(kg: KG, source: str, target: str) -> DataFrame:
    """pos, name along a shortest undirected path: of those the one of least ids; no row without a path.

    Levels of ids alone grow from both ends, the smaller frontier first, until they meet.  Then the nodes on shortest paths
    are marked from the meeting back to the source, and the path takes the least marked neighbour at each step.
    """
    a, b = need(kg, source), need(kg, target)
    spark = kg.entities.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    named = lambda path: _named(kg, spark.createDataFrame([(0, path)], "path_id int, path array<long>")).select("pos", "name")
    if a == b:
        return named([a])
    steps = _steps(kg.relations, "both")
    levels, sizes = ([one(a)], [one(b)]), [1, 1]
    while True:
        side = 0 if sizes[0] <= sizes[1] else 1
        own, other = levels[side], levels[1 - side]
        # a level's neighbours are in it, beside it, or in the next one
        fresh = _next(kg, own[-1], steps)
        for known in own[-2:]:
            fresh = fresh.join(known, "id", "left_anti")
        own.append(stored(fresh, "level"))
        sizes[side] = own[-1].count()
        if not sizes[side]:
            return spark.createDataFrame([], "pos int, name string")
        meet = own[-1].join(other[-1], "id", "left_semi")
        if not meet.isEmpty():
            break
    ways = [stored(meet, "level")]
    for level in levels[0][-2:0:-1]:
        ways.append(stored(level.join(_next(kg, ways[-1], steps), "id", "left_semi"), "level"))
    path = [a]
    for level in (*(reversed(ways) if len(levels[0]) > 1 else ()), *levels[1][-2::-1]):
        path.append(_next(kg, one(path[-1]), steps).join(level, "id", "left_semi").agg(F.min("id")).first()[0])
    return named(path)


#: Pairs that go at once; and the words of 64 pairs that a row of a level has.
MAX_PAIRS = 1 << 20
_WORDS = 8
_BITS = [f"w{i}" for i in range(_WORDS)]


def find_paths(kg: KG, pairs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """pair_id, pos, name: ``find_path`` for many pairs (pair_id, source, target) at once; no rows for a pair without a path.

    All pairs grow together from both ends, the smaller frontier first: a level has a row for each node and block of 512 pairs that has some
    there, a bit for each of them, so a level is one join with the edges and one aggregation however many pairs there are.  A pair whose ends
    have met, or one of whose ends is exhausted, grows no further.  Then the edges on shortest paths are marked from the meetings back to the
    sources, and all paths walk together, each to the least neighbour.  More than ``MAX_PAIRS`` pairs go in portions of that many.
    """
    ids = lambda name, to: kg.entities.select(F.col("name").alias(name), F.col("id").alias(to))
    asked = pairs.select("pair_id", "source", "target").join(ids("source", "a"), "source").join(ids("target", "b"), "target").select("pair_id", "a", "b")
    numbered = stored(number(asked, ["pair_id", "a", "b"]), "pairs")
    count = numbered.count()
    steps = _steps(kg.relations, "both").select("here", "there").filter("here <> there")
    if kg.layout is None:
        steps = stored(steps, "steps")
    whole = kg.entities.sparkSession.createDataFrame([], "pair_id long, pos int, node long")
    for start in range(0, count, MAX_PAIRS):
        own = numbered.filter((F.col("place") > start) & (F.col("place") <= start + MAX_PAIRS)).select((F.col("place") - start - 1).cast("int").alias("n"), "pair_id", "a", "b")
        whole = whole.unionByName(_paths(own, steps, max_depth))
    return whole.join(kg.name_of(None).select(F.col("id").alias("node"), "name").hint("merge"), "node").select("pair_id", "pos", "name")


def _some() -> Column:
    return F.greatest(*(F.col(w) != 0 for w in _BITS))


def _both(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the bits that ``other`` has too, where any are left.

    Files of bits are far smaller than their rows, so joins on nodes are not left to Spark, which would broadcast them; a row for each block is.
    """
    also = other.select(*on, *(F.col(w).alias(f"o{w}") for w in _BITS)).hint("merge" if "id" in on else "broadcast")
    rest = [c for c in rows.columns if c not in _BITS]
    return rows.join(also, on).select(*rest, *(F.col(w).bitwiseAND(F.col(f"o{w}")).alias(w) for w in _BITS)).filter(_some())


def _marks(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.bit_or(w).alias(w) for w in _BITS))


def _paths(numbered: DataFrame, steps: DataFrame, max_depth: int) -> DataFrame:
    """pair_id, pos, node of a portion of pairs (n from 0, pair_id, a, b)."""
    spark = numbered.sparkSession
    block = F.shiftright("n", 9).alias("block")
    bits = [F.when(F.shiftright("n", 6).bitwiseAND(F.lit(_WORDS - 1)) == i, F.expr("shiftleft(1L, n & 63)")).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(_BITS)]
    has = F.lit(False)
    for i, w in enumerate(_BITS):
        has = has | ((F.shiftright("n", 6).bitwiseAND(F.lit(_WORDS - 1)) == i) & (F.expr(f"shiftrightunsigned({w}, n & 63) & 1L") == 1))
    start = lambda end: stored(_marks(numbered.select(F.col(end).alias("id"), block, *bits), F.col("id"), F.col("block")), "level")
    moved = lambda rows: rows.join(steps.withColumnRenamed("here", "id").hint("merge"), "id")
    sides = [start("a")], [start("b")]
    sizes, met = [s[0].count() for s in sides], {}
    # a row for each block of 512 pairs: those that are to grow
    open_ = stored(_marks(numbered.select(block, *bits), F.col("block")), "open")
    for depth in range(max_depth + 1):
        # of each pair all places of its first meeting
        meet = stored(_both(_both(sides[0][-1], sides[1][-1], ["id", "block"]), open_, ["block"]), "meet")
        if not meet.isEmpty():
            met[len(sides[0]) - 1, len(sides[1]) - 1] = meet
            open_ = stored(_without(open_, _marks(meet, F.col("block")), ["block"]), "open")
        if depth == max_depth or open_.isEmpty():
            break
        side = 0 if sizes[0] <= sizes[1] else 1
        own = sides[side]
        grown = moved(_both(own[-1], open_, ["block"]))
        fresh = _marks(grown, F.col("there").alias("id"), F.col("block"))
        # a level's neighbours are in it, beside it, or in the next one
        for known in own[-2:]:
            fresh = _without(fresh, known, ["id", "block"])
        own.append(stored(fresh, "level"))
        sizes[side] = own[-1].count()
        # a pair that has nothing new on one side has no path
        open_ = stored(_both(open_, _marks(own[-1], F.col("block")), ["block"]), "open")
        if open_.isEmpty():
            break
    none = spark.createDataFrame([], "n int, pair_id long, node long, pos int")
    if not met:
        return none.select("pair_id", "pos", "node")
    # edges from the nodes of a level of the sources to those of the next one that lie on shortest paths
    far = max(i for i, _ in met)
    ways, marks = {}, None
    for i in range(far, -1, -1):
        parts = [m for (j, _), m in met.items() if j == i]
        if i < far:
            ways[i] = stored(_both(moved(marks).select(F.col("there").alias("id"), "block", F.col("id").alias("next"), *_BITS), sides[0][i], ["id", "block"]), "ways")
            parts.append(_marks(ways[i], F.col("id"), F.col("block")))
        marks = parts[0]
        for part in parts[1:]:
            marks = marks.unionByName(part)
        marks = stored(_marks(marks, F.col("id"), F.col("block")), "marks") if i else None
    # how far each pair's meeting is from either end
    stages = [m.select("block", F.lit(i).alias("i"), F.lit(j).alias("j"), *_BITS) for (i, j), m in met.items()]
    own = stages[0]
    for part in stages[1:]:
        own = own.unionByName(part)
    own = _marks(own, F.col("block"), F.col("i"), F.col("j"))
    walk = numbered.withColumn("block", block).join(F.broadcast(own), "block").filter(has)
    walk = stored(walk.select("n", "pair_id", "block", "i", "j", F.col("a").alias("node"), F.lit(0).alias("pos")), "walk")
    out, keys = [walk], ["n", "pair_id", "block", "i", "j", "pos"]
    least = lambda near, to: near.filter(has).groupBy(*keys).agg(F.min(to).alias("node")).withColumn("pos", F.col("pos") + 1)
    for i in range(far):
        near = walk.filter(F.col("i") > i).join(ways[i].withColumnRenamed("id", "node").hint("merge"), ["node", "block"])
        # those that have met wait for the others
        went = stored(least(near, "next"), "walk")
        out.append(went)
        walk = walk.filter(F.col("i") <= i).unionByName(went)
    for j in range(max(j for _, j in met) - 1, -1, -1):
        near = walk.filter(F.col("j") > j).join(steps.withColumnRenamed("here", "node").hint("merge"), "node")
        near = near.join(sides[1][j].withColumnRenamed("id", "there").hint("merge"), ["there", "block"])
        went = stored(least(near, "there"), "walk")
        out.append(went)
        walk = walk.filter(F.col("j") <= j).unionByName(went)
    whole = none
    for part in out:
        whole = whole.unionByName(part.select(none.columns))
    return stored(whole.select("pair_id", "pos", "node"), "paths")


def _without(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without the bits that ``known`` has, where any are left."""
    old = known.select(*on, *(F.col(w).alias(f"o{w}") for w in _BITS)).hint("merge")
    rest = [c for c in rows.columns if c not in _BITS]
    left = (F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"o{w}"), F.lit(0).cast("long")))).alias(w) for w in _BITS)
    return rows.join(old, on, "left").select(*rest, *left).filter(_some())


def find_all_paths(kg: KG, source: str, target: str, max_depth: int = 6, max_paths: int = 50, distinct: bool = False) -> DataFrame:
    """path_id, pos, name of simple undirected paths, shortest first, then by ids.

    Parallel and reciprocal edges make paths of their own unless ``distinct``.  Length by length, paths grown from the source
    meet those grown from the target halfway, so a frontier has half the steps; the search ends with the length that
    brings ``max_paths``, as longer ones come after it.
    """
    a, b = need(kg, source), need(kg, target)
    max_depth, max_paths = min(max_depth, 10), min(max_paths, 100)
    spark = kg.entities.sparkSession
    schema = "id long, path array<long>"
    if a == b:
        return _named(kg, spark.createDataFrame([(0, [a])], "path_id int, path array<long>"))
    every = _steps(kg.relations, "both") if kg.layout is not None else stored(_steps(kg.relations, "both"), "steps")

    def grown(half: DataFrame, other: int, first: bool) -> DataFrame:
        """One step more; a path that holds the other end is complete and grows no further."""
        half = half.filter(F.col("id") != other)
        ids = kg.few(half.select("id").distinct())
        steps = (every if ids is None else _steps_of(kg, ids, "both")).select("here", "there").filter("here <> there")
        steps = steps.distinct() if distinct else steps
        moved = half.join(steps, F.col("id") == F.col("here")).filter(~F.array_contains("path", F.col("there")))
        step = F.array("there")
        return stored(moved.select(F.col("there").alias("id"), (F.concat("path", step) if first else F.concat(step, "path")).alias("path")), "paths")

    head, tail = spark.createDataFrame([(a, [a])], schema), spark.createDataFrame([(b, [b])], schema)
    found: list[list[int]] = []
    for length in range(1, max_depth + 1):
        # paths of ``length`` steps: half of them, rounded down, from the source, the others from the target
        head, tail = (head, grown(tail, a, False)) if length % 2 else (grown(head, b, True), tail)
        ends = tail.select("id", F.col("path").alias("rest"))
        whole = head.join(ends, "id").filter(F.size(F.array_intersect("path", "rest")) == 1)
        whole = whole.select(F.concat("path", F.slice("rest", 2, max_depth + 1)).alias("path"))
        found += [r["path"] for r in whole.orderBy("path").limit(max_paths - len(found)).collect()]
        if len(found) >= max_paths or head.isEmpty() or tail.isEmpty():
            break
    return _named(kg, spark.createDataFrame(list(enumerate(found)), "path_id int, path array<long>"))
