"""Vectors packed into blocks, so that many queries meet many vectors as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1024
PACKED = "ids binary, matrix binary, dims int"
FOUND = "query_id long, entity_id long, score double"


def matrix_distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    ip = a @ b.T
    if metric == "ip":
        return 1 - ip
    if metric == "l2sq":
        return np.maximum(0, (a**2).sum(1)[:, None] - 2 * ip + (b**2).sum(1)[None, :])
    size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(size == 0, 1.0, 1 - ip / np.where(size == 0, 1, size))


def matrix_of(column: pa.Array) -> np.ndarray:
    """A matrix of an array column; all rows have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _out(ids: np.ndarray, rows: np.ndarray, names: list[str], lead: list[pa.Array]) -> pa.RecordBatch:
    made = [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([rows.astype("<f4").tobytes()], pa.binary()), pa.array([rows.shape[1]], pa.int32())]
    return pa.RecordBatch.from_arrays([*lead, *made], names=[*names, "ids", "matrix", "dims"])


def packed(rows: DataFrame, key: str, most: int = ROWS, by: str | None = None) -> DataFrame:
    """Rows (``key``, embedding) in blocks of at most ``most``: ids, matrix, dims; with ``by`` (int) rows of its values apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column("embedding").is_valid().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, bool)
            batch = batch.filter(pa.array(keep))
            if not batch.num_rows:
                continue
            v, ids = matrix_of(batch.column("embedding")), batch.column(key).to_numpy()
            groups = [(None, np.arange(len(ids)))]
            if by:
                own = batch.column(by).to_numpy()
                groups = [(int(c), np.flatnonzero(own == c)) for c in np.unique(own)]
            for c, at in groups:
                for i in range(0, len(at), most):
                    part = at[i : i + most]
                    yield _out(ids[part], v[part], [by] if by else [], [pa.array([c], pa.int32())] if by else [])

    return rows.select(*([by] if by else []), key, "embedding").mapInArrow(run, (f"{by} int, " if by else "") + PACKED)


def unpacked(ids: bytes, matrix: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f4").reshape(-1, max(dims, 1)).astype(np.float64)


def best_of(pairs: DataFrame, k: int, score: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """query_id, entity_id, score of the best ``k`` for each query over rows that pair queries with vectors.

    ``score`` gives of such a row the queries' ids, the vectors' ids (one row of candidates for each query, or one for all) and the
    distances. A task keeps its k best for each query it has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                asked, ids, d = score({n: c[i] for n, c in columns.items()})
                d = np.round(d, 6)
                # those that can be among the best: no farther than the k-th of the row, ties too
                worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                for j, q in enumerate(asked.tolist()):
                    own = ids[j] if ids.ndim == 2 else ids
                    s, e = best.get(q, (np.zeros(0), np.zeros(0, np.int64)))
                    at = np.flatnonzero(d[j] <= (min(worst[j], s[-1]) if len(s) == k else worst[j]))
                    if not len(at) and len(s):
                        continue
                    s, e = np.concatenate([s, d[j, at]]), np.concatenate([e, own[at]])
                    top = np.lexsort((e, s))[:k]
                    top = top[np.isfinite(s[top])]
                    best[q] = s[top], e[top]
        keys = list(best)
        for at in range(0, len(keys), 1 << 12):
            part = keys[at : at + (1 << 12)]
            n = [len(best[q][0]) for q in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(part, np.int64), n)), pa.array(np.concatenate([best[q][1] for q in part]), pa.int64()), pa.array(np.concatenate([best[q][0] for q in part]))],
                names=["query_id", "entity_id", "score"],
            )

    found = pairs.mapInArrow(run, FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "entity_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, recall: the share of the exact pairs (query_id, entity_id) that were found."""
    pairs = exact.select("query_id", "entity_id").join(found.select("query_id", "entity_id", F.lit(1).alias("hit")), ["query_id", "entity_id"], "left")
    return pairs.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
