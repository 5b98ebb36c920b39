"""Connected components; nothing but counts reaches the driver.

Each task reduces its edges to a spanning forest.  What is left of up to ``alone`` edges is joined by one task, and more by
alternating star contraction over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sparing, stored


def _large(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of those."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't its component's least, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            hung = root != np.arange(len(nodes))
            return nodes[hung], nodes[root[hung]]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _forest(most: int):
    """Edges (a, b) of a task reduced to those to their components' least nodes, ``most`` edges or more at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        parts, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 2 * most:
                a, b = least_nodes(*(np.concatenate(v) for v in zip(*parts, strict=True)))
                parts, size = [(a, b)], len(a)
                if size > most:
                    yield out(a, b)
                    parts, size = [(a[:0], b[:0])], 0
        yield out(*least_nodes(*(np.concatenate(v) for v in zip(*parts, strict=True))))

    return run


def components(edges: DataFrame, max_rounds: int = 60, alone: int = 1 << 20) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least node, the root."""
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(sparing(_forest(1 << 20)), "a long, b long"), "edges")
    if now.count() <= alone:
        return stored(now.coalesce(1).mapInArrow(sparing(_forest(max(alone, 1 << 20))), "a long, b long").toDF("node", "root"), "roots")
    now = stored(now.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = stored(_small(_large(now)).coalesce(max(6, mark[0] >> 18)), "edges")  # as many files as the edges need
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
