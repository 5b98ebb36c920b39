"""Distances of float arrays, in double; smaller is closer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 where either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "cos":
        return cosine(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"metric must be cos, ip or l2sq, not {metric}")
