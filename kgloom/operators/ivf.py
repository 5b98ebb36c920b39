"""Inverted-file index: vectors by the cell of their nearest centroid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .blocks import ROWS, best_of, matrix_distance, matrix_of, packed, unpacked
from .vector import clamp_k, knn

ROUNDS = 15


def centroids(rows: np.ndarray, cells: int, metric: str) -> np.ndarray:
    """Farthest-point seeds from row 0 on, then at most 15 Lloyd rounds; an empty cell keeps its centroid."""
    k = min(cells, len(rows))
    seeds = [0]
    near = matrix_distance(rows, rows[:1], metric)[:, 0]
    while len(seeds) < k:
        seeds.append(int(near.argmax()))
        near = np.minimum(near, matrix_distance(rows, rows[seeds[-1:]], metric)[:, 0])
    c = rows[seeds].copy()
    own = None
    for _ in range(ROUNDS):
        now = matrix_distance(rows, c, metric).argmin(1)
        if own is not None and (now == own).all():
            break
        own = now
        for i in np.unique(own):
            c[i] = rows[own == i].mean(0)
    return c


@dataclass(frozen=True)
class IvfIndex:
    cells: DataFrame  # entity_id, embedding, cell
    centroids: np.ndarray
    metric: str
    nprobe: int = 8
    kind = "ivf"

    def search(self, query: Sequence[float], k: int, nprobe: int | None = None) -> DataFrame:
        """entity_id, score of the nearest in the ``nprobe`` cells closest to the query.

        A table written by ``cell`` is read only in those partitions.
        """
        n = max(1, min(nprobe or self.nprobe, len(self.centroids)))
        d = matrix_distance(np.asarray([query], np.float64), self.centroids, self.metric)[0]
        chosen = np.argsort(d, kind="stable")[:n].tolist()
        return knn(self.cells.filter(F.col("cell").isin(*chosen)), query, clamp_k(k), self.metric)

    def search_many(self, queries: DataFrame, k: int, nprobe: int = 8, block: int = ROWS) -> DataFrame:
        """query_id, entity_id, score, rank: as ``search`` for each of ``queries`` (query_id, embedding).

        Each query goes to the cells it looks into; blocks of a cell's queries meet blocks of its vectors by a join on the cell.
        """
        n, c, metric = max(1, min(nprobe, len(self.centroids))), self.centroids, self.metric

        def probe(batches):
            for batch in batches:
                if batch.num_rows:
                    q = matrix_of(batch.column("embedding")).astype(np.float64)
                    cells = np.argsort(matrix_distance(q, c, metric), axis=1, kind="stable")[:, :n]
                    at = pa.array(np.repeat(np.arange(len(q)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), batch.column("query_id").take(at), batch.column("embedding").take(at)], names=["cell", "query_id", "embedding"])

        probes = queries.select("query_id", "embedding").filter("embedding is not null").mapInArrow(probe, "cell int, query_id long, embedding array<float>")
        asked = stored(packed(probes.repartition("cell").sortWithinPartitions("cell"), "query_id", block, by="cell").toDF("cell", "q_ids", "q_matrix", "q_dims"), "queries")

        def score(row: dict):
            ids, v = unpacked(row["ids"], row["matrix"], row["dims"])
            q_ids, q = unpacked(row["q_ids"], row["q_matrix"], row["q_dims"])
            return q_ids, ids, matrix_distance(q, v, metric)

        return best_of(packed(self.cells, "entity_id", block, by="cell").join(asked, "cell"), k, score)

    def upsert(self, vectors: DataFrame) -> IvfIndex:
        """The index with ``vectors`` (entity_id, embedding) in place of those of the same ids; centroids stay."""
        return self.remove(vectors.select("entity_id")).bulk_load(vectors)

    def remove(self, ids: DataFrame) -> IvfIndex:
        """The index without the vectors of ``ids`` (entity_id)."""
        return replace(self, cells=self.cells.join(ids.select("entity_id"), "entity_id", "left_anti"))

    def bulk_load(self, vectors: DataFrame) -> IvfIndex:
        """The index and ``vectors``, of which no id is in it yet: nothing is looked up or shuffled."""
        return replace(self, cells=self.cells.unionByName(assign(vectors, self.centroids, self.metric)))

    def save(self, path: str) -> IvfIndex:
        """The index with its cells written as partitions, of which a search reads the probed ones alone."""
        dealt = self.cells.select("entity_id", "embedding", "cell").repartitionByRange("cell", "entity_id").sortWithinPartitions("cell", "entity_id")
        dealt.write.partitionBy("cell").parquet(path)
        return replace(self, cells=self.cells.sparkSession.read.schema("entity_id long, embedding array<float>, cell int").parquet(path))


def assign(vectors: DataFrame, c: np.ndarray, metric: str) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for batch in batches:
            v = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, sent.value.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("entity_id"), batch.column("embedding"), pa.array(matrix_distance(v, sent.value, metric).argmin(1).astype(np.int32) if len(v) else np.zeros(0, np.int32))], names=["entity_id", "embedding", "cell"])

    return vectors.select("entity_id", "embedding").mapInArrow(run, "entity_id long, embedding array<float>, cell int")


def train(vectors: DataFrame, cells: int = 64, metric: str = "cos", max_rows: int = 20_000) -> IvfIndex:
    """Centroids from the first ``max_rows`` vectors in a seeded order (all where there are fewer, by id), cells for every vector."""
    sample = vectors.select("entity_id", "embedding").orderBy(F.xxhash64("entity_id"), "entity_id").limit(max_rows)
    rows = sample.orderBy("entity_id").collect()
    if not rows:
        return IvfIndex(vectors.select("entity_id", "embedding").withColumn("cell", F.lit(0)), np.zeros((1, 1)), metric)
    c = centroids(np.array([r["embedding"] for r in rows], np.float64), cells, metric)
    return IvfIndex(assign(vectors, c, metric), c, metric)
