"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to (their pattern).  The flow network is
``start -> pattern -> source -> end``: a pattern sends its words once at the first cost and again at a
higher one (the r-th copy of a word costs 2r - 1, which is convex), a source takes its target.  Patterns
and sources that share nothing are separate networks, each solved on the driver; what the driver holds is
bounded by ``max_patterns``.  Documents are then laid out in a seeded order along their pattern's words, and
every copy of a document goes to the source whose flow its middle word falls in, so each source ends within
one document of its flow.  Positions come from bucket totals and running sums inside buckets, so no source's
rows meet in one task.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; documents of size 0
take 0; with no words at all every target is 0; equal rows are interchangeable; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, stored

WORD = r"[^\x20\x09-\x0D]+"


def capped_targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Split ``share`` times all sizes by weight; no target is above ``cap`` times its size."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > cap * sizes[i]}
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else unit * weights[i]
        left -= sum(out[i] for i in over)
        open_ -= over or open_
    return out


def min_cost_flow(capacity: Sequence[int], members: Sequence[Sequence[int]], quota: dict[int, int], copies: int) -> list[dict[tuple[int, int], int]]:
    """For each pattern the words sent by (source, copy number from 1): most words first, then least cost.

    Successive shortest paths with potentials; a copy of a pattern is an edge of its own.
    """
    n = len(capacity)
    name = {s: n + k for k, s in enumerate(sorted(quota))}
    start, end = n + len(name), n + len(name) + 1
    to: list[int] = []
    left: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, most: int, price: int) -> int:
        for x, y, c, p in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
        return len(to) - 2

    layer = {(p, r): edge(start, p, capacity[p], 2 * r - 1) for p in range(n) for r in range(1, copies + 1)}
    sent = {(p, s): edge(p, name[s], copies * capacity[p], 0) for p in range(n) for s in members[p]}
    for s, k in name.items():
        edge(k, end, quota[s], 0)
    height = [0] * (end + 1)
    while True:
        dist, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        dist[start], heap = 0, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if left[e] and (step := d + cost[e] + height[x] - height[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = step, e
                    heapq.heappush(heap, (step, to[e]))
        if via[end] < 0:
            break
        far = dist[end]
        height = [h + min(d, far) for h, d in zip(height, dist, strict=True)]
        x, most = end, None
        while x != start:
            most = left[via[x]] if most is None else min(most, left[via[x]])
            x = to[via[x] ^ 1]
        x = end
        while x != start:
            left[via[x]] -= most
            left[via[x] ^ 1] += most
            x = to[via[x] ^ 1]
    found: list[dict[tuple[int, int], int]] = []
    for p in range(n):
        # a pattern's words by source, poured into its copies one after another
        room, r, mine = {r: left[layer[p, r] ^ 1] for r in range(1, copies + 1)}, 1, {}
        for s in members[p]:
            words = left[sent[p, s] ^ 1]
            while words and r <= copies:
                got = min(words, room[r])
                if got:
                    mine[s, r] = got
                room[r] -= got
                words -= got
                if not room[r]:
                    r += 1
        found.append(mine)
    return found


def components(members: Sequence[Sequence[int]]) -> list[list[int]]:
    """Patterns grouped by the sources they share, directly or through others."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for m in members:
        for s in m[1:]:
            root[find(s)] = find(m[0])
    groups = defaultdict(list)
    for p, m in enumerate(members):
        groups[find(m[0])].append(p)
    return list(groups.values())


def _labelled(docs: DataFrame, sources: Column, seed: int, names: Sequence[str]) -> DataFrame:
    """``docs`` with four columns of these names: size, pattern, the sources, and the place in the seeded order."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    own = F.array_distinct(sources)
    label = F.transform(F.array_sort(own), lambda s: F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.sha1(F.coalesce("text", F.lit(""))))
    return docs.select("*", *(c.alias(n) for c, n in zip((size, F.array_join(label, ","), own, order), names, strict=True)))


def mix_sources(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    copies: int = 2,
    seed: int = 17,
    max_patterns: int = 100_000,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, spans (source, copy) and the document's place.

    ``sources`` is an array of source names; ``weights`` repeat over the sources in code point order.
    source_size and target are sums over the document's sources.
    """
    spark = docs.sparkSession
    made = fresh(docs, "mix_size", "mix_pattern", "mix_own", "mix_o")
    labelled = _labelled(docs, sources, seed, made)
    narrow = stored(labelled.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(m).alias(n) for m, n in zip(made, ("size", "pattern", "own", "o"), strict=True))), "mix-sizes")
    patterns = narrow.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.any_value("own").alias("own"))
    found = patterns.limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns: raise max_patterns, or name sources more coarsely")
    found.sort(key=lambda x: x["pattern"])
    names = sorted({s for x in found for s in x["own"]}, key=lambda s: (s is None, s or ""))  # str order is code point order
    number = {s: i for i, s in enumerate(names)}
    members = [sorted(number[s] for s in x["own"]) for x in found]
    words = [x["words"] or 0 for x in found]
    sizes = [0] * len(names)
    for m, w in zip(members, words, strict=True):
        for s in m:
            sizes[s] += w
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(words) / max(1, sum(sizes)), copies)
    rows = []
    for group in components(members):
        quota = {s: round(targets[s]) for p in group for s in members[p]}
        for p, flow in zip(group, min_cost_flow([words[p] for p in group], [members[p] for p in group], quota, copies), strict=True):
            at, spans = defaultdict(int), []
            for (s, r), n in sorted(flow.items(), key=lambda x: (x[0][1], x[0][0])):
                spans.append({"copy": r, "lo": at[r], "hi": at[r] + n, "source": names[s]})
                at[r] += n
            rows.append((found[p]["pattern"], sum(sizes[s] for s in members[p]), float(sum(targets[s] for s in members[p])), spans))
    span = pa.struct([("copy", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("source", pa.string())])
    kinds = {"pattern": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "spans": pa.list_(span)}
    # as Arrow columns: rows of Python objects would start Python workers on every executor to be read
    plan = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds)))

    buckets = 1 << max(6, (max(1, sum(x["rows"] for x in found)) >> 16).bit_length())
    placed = narrow.withColumn("bucket", F.shiftrightunsigned("o", 64 - (buckets.bit_length() - 1)))
    totals = placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("pattern", "bucket", before.alias("bucket_start"))
    inside = F.sum("size").over(Window.partitionBy("pattern", "bucket").orderBy("o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("bucket_start") + F.col("inside") - F.col("size") / 2
    laid = placed.withColumn("inside", inside).join(starts, ["pattern", "bucket"]).withColumn("middle", middle)
    went = F.filter("spans", lambda x: (x["lo"] <= F.col("middle")) & (F.col("middle") < x["hi"]) & (F.col("size") > 0))
    chosen = laid.join(F.broadcast(plan), "pattern").withColumn("went", went)
    return chosen.select("doc_id", "size", "source_size", "target", F.size("went").alias("copies"), (F.col("size") * F.size("went")).alias("taken"), "went", "pattern", F.struct("bucket", "o", "doc_id").alias("place"), F.lit(buckets).alias("buckets"))


def mixed(docs: DataFrame, sources: Column, seed: int = 17, **settings) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy.

    What a copy takes of a pattern is a run of the seeded order, so the runs' ends (a few for each pattern) decide
    for every document where it is read, and no text moves.
    """
    found = mix_sources(docs, sources, seed=seed, **settings)
    runs = found.select("pattern", "place", "buckets", F.explode("went").alias("w")).groupBy("pattern", "w.copy", "w.source", "buckets").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    size, pattern, own, o, first_last, buckets, copy = fresh(docs, "mix_size", "mix_pattern", "mix_own", "mix_o", "mix_runs", "mix_buckets", "mix_copy")
    plan = stored(runs.groupBy(F.col("pattern").alias(pattern), F.col("buckets").alias(buckets)).agg(F.collect_list(F.struct("first", "last")).alias(first_last)), "mix-runs")
    bucket = F.expr(f"shiftrightunsigned({o}, cast(64 - round(log2({buckets})) as int))")
    place = F.struct(bucket.alias("bucket"), F.col(o).alias("o"), F.col("doc_id").cast("long").alias("doc_id"))
    taken = F.filter(first_last, lambda x: (x["first"] <= place) & (place <= x["last"]) & (F.col(size) > 0))
    joined = _labelled(docs, sources, seed, (size, pattern, own, o)).join(F.broadcast(plan), pattern)
    return joined.withColumn(copy, F.explode(taken)).select(*docs.columns)
