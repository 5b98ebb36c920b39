"""Nearest-neighbour search and what builds on it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..sources.store import KG, stored
from .blocks import ROWS, best_of, matrix_distance, packed, unpacked
from .text import search_ids

MAX_DIMS = 4096
MAX_K = 100
MAX_ITEMS = 1024
RRF = 60


def parse_embedding(values: Sequence[float], dims: int | None = None) -> list[float]:
    """The vector as float32 values; errors name what is wrong."""
    if not len(values):
        raise ValueError("embedding is empty")
    if len(values) > MAX_DIMS:
        raise ValueError(f"embedding has over {MAX_DIMS} dimensions")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in values):
        raise ValueError("embedding holds something that is no number")
    if dims is not None and len(values) != dims:
        raise ValueError(f"embedding has {len(values)} dimensions, not {dims}")
    return np.asarray(values, np.float32).tolist()


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def clamp_k(k: int) -> int:
    return max(1, min(k, MAX_K))


def knn(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "cos") -> DataFrame:
    """entity_id, score of the ``k`` nearest; score is the distance to 6 places, ties go by id."""
    scored = vectors.select("entity_id", F.round(distance(F.col("embedding"), literal(query), metric), 6).alias("score"))
    return scored.orderBy("score", "entity_id").limit(clamp_k(k))


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cos", block: int = ROWS) -> DataFrame:
    """query_id, entity_id, score, rank of the ``k`` nearest for many queries (query_id, embedding).

    Both sides are packed into blocks, and each block of queries meets each block of vectors as one matrix product; Spark sends the
    queries to every task where they are small, and deals pairs of partitions where they are not.  A task keeps its k best for each query.
    """
    asked = stored(packed(queries, "query_id", block).toDF("q_ids", "q_matrix", "q_dims"), "queries")

    def score(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, v = unpacked(row["ids"], row["matrix"], row["dims"])
        q_ids, q = unpacked(row["q_ids"], row["q_matrix"], row["q_dims"])
        return q_ids, ids, matrix_distance(q, v, metric)

    return best_of(packed(vectors, "entity_id", block).crossJoin(asked), k, score)


def nearest(kg: KG, query: Sequence[float], k: int, metric: str) -> DataFrame:
    """``knn``, by the graph's index if it has one of this metric."""
    if kg.index is not None and kg.index.metric == metric:
        return kg.index.search(query, clamp_k(k))
    return knn(kg.embeddings, query, k, metric)


def _resolved(kg: KG, hits: DataFrame, entity_type: str | None) -> DataFrame:
    few = None
    if kg.layout is not None:  # at most MAX_K rows
        got = hits.collect()
        hits, few = kg.entities.sparkSession.createDataFrame(got, "entity_id long, score double"), [r["entity_id"] for r in got]
    rows = kg.name_of(few).join(hits, F.col("id") == F.col("entity_id")).select("id", "name", "type", "score")
    return rows.filter(F.col("type") == entity_type) if entity_type else rows


def search_entities(kg: KG, query: Sequence[float], k: int = 10, entity_type: str | None = None, metric: str = "cos") -> DataFrame:
    """name, type, score; the type filter comes after the top k."""
    return _resolved(kg, nearest(kg, query, k, metric), entity_type).orderBy("score", "id").select("name", "type", "score")


def _embeddings_of(kg: KG, ids: list[int] | None) -> DataFrame:
    return kg.embeddings if ids is None else kg.embeddings.filter(F.col("entity_id").isin(*ids))


def embedding_of(kg: KG, name: str) -> list[float] | None:
    rows, ids = kg.chosen([name])
    row = _embeddings_of(kg, ids).join(rows.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("embedding").first()
    return list(row["embedding"]) if row else None


def _excluding(kg: KG, query: Sequence[float], k: int, excluded: Sequence[str], entity_type: str | None, metric: str) -> DataFrame:
    k = clamp_k(k)
    fetch = min(max(3 * k + len(set(excluded)), k), MAX_K)
    rows = _resolved(kg, nearest(kg, query, fetch, metric), entity_type)
    return rows.filter(~F.col("name").isin(*excluded) if excluded else F.lit(True)).orderBy("score", "id").limit(k).select("name", "type", "score")


def search_by_entity(kg: KG, name: str, k: int = 10, entity_type: str | None = None, exclude_self: bool = True, metric: str = "cos") -> DataFrame:
    v = embedding_of(kg, name)
    if v is None:
        raise ValueError(f"Entity '{name}' has no embedding")
    return _excluding(kg, v, k, [name] if exclude_self else [], entity_type, metric)


def centroid(kg: KG, names: Sequence[str]) -> DataFrame:
    """pos, value: the mean of the named vectors; a name given twice counts twice."""
    asked = kg.entities.sparkSession.createDataFrame([(n,) for n in names], "name string")
    own, ids = kg.chosen(names)
    rows = _embeddings_of(kg, ids).join(own.join(F.broadcast(asked), "name").select(F.col("id").alias("entity_id")), "entity_id")
    return rows.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("value"))


def recommend(kg: KG, positive: Sequence[str], negative: Sequence[str] = (), k: int = 10, entity_type: str | None = None, metric: str = "cos") -> DataFrame:
    """Nearest to the mean of the positive examples less that of the negative ones."""
    plus = {r["pos"]: r["value"] for r in centroid(kg, positive).collect()} if positive else {}
    if not plus:
        raise ValueError("no positive example has an embedding")
    minus = {r["pos"]: r["value"] for r in centroid(kg, negative).collect()} if negative else {}
    q = [float(np.float32(plus[i] - minus.get(i, 0.0))) for i in sorted(plus)]
    return _excluding(kg, q, k, [*positive, *negative], entity_type, metric)


def mmr_order(pool: np.ndarray, query: np.ndarray, k: int, weight: float) -> list[tuple[int, float]]:
    """Greedy choice of ``k`` rows: relevance less the greatest similarity to what is chosen; first of equals."""
    size = np.linalg.norm(pool, axis=1)
    unit = pool / np.where(size == 0, 1, size)[:, None]
    q = query / (np.linalg.norm(query) or 1)
    rel, near, left, out = unit @ q, np.zeros(len(pool)), list(range(len(pool))), []
    while left and len(out) < k:
        score = np.round(weight * rel[left] - (1 - weight) * near[left], 9)
        best = left[int(np.argmax(score))]
        out.append((best, float(score.max())))
        left.remove(best)
        near = np.maximum(near, unit @ unit[best])
    return out


def mmr_search(kg: KG, query: Sequence[float], k: int = 10, fetch_k: int | None = None, weight: float = 0.5, entity_type: str | None = None, metric: str = "cos") -> DataFrame:
    """rank, name, type, score (the MMR value); the pool of at most 100 rows is ordered in one task."""
    k, weight = clamp_k(k), max(0.0, min(1.0, weight))
    fetch = max(k, min(MAX_K, fetch_k or max(20, 4 * k)))
    pool = _resolved(kg, nearest(kg, query, fetch, metric), entity_type)
    pool = pool.join(_embeddings_of(kg, kg.few(pool)), F.col("id") == F.col("entity_id")).select("id", "name", "type", "score", "embedding")
    q = np.asarray(query, np.float64)

    def choose(rows):
        rows = rows.sort_values(["score", "id"]).reset_index(drop=True)
        picked = mmr_order(np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1), q, k, weight)
        out = rows.loc[[i for i, _ in picked], ["name", "type"]].reset_index(drop=True)
        return out.assign(rank=range(1, len(out) + 1), score=[round(s, 6) for _, s in picked])[["rank", "name", "type", "score"]]

    return pool.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(choose, "rank int, name string, type string, score double")


def graph_cache(kg: KG) -> DataFrame:
    """from_id, to_id: distinct directed edges between embedded entities."""
    ids = kg.embeddings.select("entity_id")
    edges = kg.relations.select("from_id", "to_id").distinct()
    return edges.join(ids, F.col("from_id") == F.col("entity_id"), "left_semi").join(ids, F.col("to_id") == F.col("entity_id"), "left_semi")


def graph_cache_stats(kg: KG) -> DataFrame:
    return kg.embeddings.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(graph_cache(kg).agg(F.count(F.lit(1)).alias("edges")))


def hybrid_search(kg: KG, text: str, query: Sequence[float], text_weight: float = 0.5, vec_weight: float = 0.5, k: int = 10, boost: bool = False, metric: str = "cos") -> DataFrame:
    """name, type, score, text_score, vec_score: reciprocal ranks of both legs summed by weight.

    ``boost`` adds 0.1 * d / (d + 5) to the score of an entity with d embedded out-neighbours.
    """
    k = clamp_k(k)
    near = nearest(kg, query, 3 * k, metric)
    # both legs have at most 300 rows, which one task ranks
    vec = near.select(F.col("entity_id").alias("id"), (F.row_number().over(Window.orderBy("score", "entity_id")) - 1).alias("r")).select("id", (F.lit(vec_weight) / (RRF + F.col("r"))).alias("vec_score"))
    found = search_ids(kg, text, None, 0, 3 * k).select("id", (F.row_number().over(Window.orderBy("rank")) - 1).alias("r")).select("id", (F.lit(text_weight) / (RRF + F.col("r"))).alias("text_score"))
    zero = F.lit(0.0)
    rows = found.join(vec, "id", "full_outer").select("id", F.coalesce("text_score", zero).alias("text_score"), F.coalesce("vec_score", zero).alias("vec_score"))
    score = F.col("text_score") + F.col("vec_score")
    if boost:
        d = graph_cache(kg).join(rows.select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy("from_id").agg(F.count(F.lit(1)).alias("d")).withColumnRenamed("from_id", "id")
        rows = rows.join(d, "id", "left")
        score = score + F.coalesce(0.1 * F.col("d") / (F.col("d") + 5), zero)
    rows = rows.select("id", F.round(score, 6).alias("score"), F.round("text_score", 6).alias("text_score"), F.round("vec_score", 6).alias("vec_score"), score.alias("exact"))
    top = rows.orderBy(F.desc(F.round("exact", 9)), "id").limit(k)
    return top.join(kg.entities.select("id", "name", "type"), "id").orderBy(F.desc("score"), "id").select("name", "type", "score", "text_score", "vec_score")


def batch_upsert(kg: KG, items: DataFrame, dims: int | None = None) -> tuple[KG, DataFrame]:
    """Insert or replace vectors (pos, name, embedding, model); the last item of an entity counts.

    Also returns an outcome for each item: pos, name, error (null where it went in).
    """
    joined = items.join(kg.entities.select("name", "id"), "name", "left")
    size = F.size("embedding")
    error = F.when(F.col("id").isNull(), F.lit("unknown entity")).when(F.col("embedding").isNull() | (size == 0), F.lit("empty embedding")).when(size > MAX_DIMS, F.lit("too many dimensions"))
    if dims is not None:
        error = error.when(size != dims, F.lit("wrong dimensions"))
    judged = joined.withColumn("error", error)
    last = judged.filter("error is null").groupBy(F.col("id").alias("entity_id")).agg(F.max_by(F.struct("embedding", "model"), "pos").alias("v"))
    new = last.select("entity_id", F.col("v.embedding").cast("array<float>").alias("embedding"), F.col("v.model").alias("model"))
    old = kg.embeddings.join(new.select("entity_id"), "entity_id", "left_anti").select("entity_id", "embedding", "model")
    index = kg.index and kg.index.upsert(stored(new, "upserted").select("entity_id", "embedding"))
    return kg.with_(embeddings=old.unionByName(new), index=index), judged.select("pos", "name", "error")


def upsert_embedding(kg: KG, name: str, values: Sequence[float], model: str = "", dims: int | None = None) -> KG:
    vector = parse_embedding(values, dims)
    grown, outcome = batch_upsert(kg, kg.entities.sparkSession.createDataFrame([(0, name, vector, model)], "pos int, name string, embedding array<float>, model string"))
    if error := outcome.first()["error"]:
        raise ValueError(f"{error}: {name}")
    return grown


def get_embedding(kg: KG, name: str) -> DataFrame:
    """name, dims, model, embedding; no row where there is none."""
    rows, ids = kg.chosen([name])
    return rows.join(_embeddings_of(kg, ids), F.col("id") == F.col("entity_id")).select("name", F.size("embedding").alias("dims"), "model", "embedding")


def delete_embedding(kg: KG, name: str) -> tuple[KG, bool]:
    gone = kg.chosen([name])[0].select(F.col("id").alias("entity_id"))
    had = not kg.embeddings.join(gone, "entity_id", "left_semi").isEmpty()
    index = kg.index and kg.index.remove(gone)
    return kg.with_(embeddings=kg.embeddings.join(gone, "entity_id", "left_anti").select("entity_id", "embedding", "model"), index=index), had


def store_stats(kg: KG, index_kind: str | None = None) -> DataFrame:
    index_kind = index_kind or (kg.index.kind if kg.index is not None else "exact")
    dims = F.coalesce(F.max(F.size("embedding")), F.lit(0))
    n = F.count(F.lit(1))
    return kg.embeddings.agg(n.alias("embeddings"), dims.alias("dims"), (n * dims * 4).alias("bytes"), F.lit(index_kind).alias("index_kind"))
