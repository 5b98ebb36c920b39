"""Quantized vectors: a seeded random rotation, scalar codebooks and a one-bit residual sketch.

Published method: coordinates of a randomly rotated unit vector are nearly normal, so one optimal scalar
codebook serves them all; the residual's signs under a random projection make inner products unbiased.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cache, cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance
from ..sources.store import stored
from .blocks import best_of, packed, unpacked
from .vector import knn

U = np.uint64
#: Fixed values of the generator and of the store's seed.
GAMMA = 0x9E3779B97F4A7C15
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SALT_SIGNS, SALT_PROJECTION = 0x0517, 0x0951
STORE_SEED = 0x7042904250455254
MIN_DIMS, MAX_DIMS = 384, 1536


def splitmix(seed: int, n: int, start: int = 0) -> np.ndarray:
    """Values start..start+n-1 of the SplitMix64 stream of a seed, by counter."""
    with np.errstate(over="ignore"):
        z = U(seed & (2**64 - 1)) + np.arange(start + 1, start + n + 1, dtype=U) * U(GAMMA)
        z = (z ^ (z >> U(30))) * U(MIX1)
        z = (z ^ (z >> U(27))) * U(MIX2)
        return z ^ (z >> U(31))


def salted(seed: int, salt: int) -> int:
    return int(splitmix(seed ^ (salt * GAMMA), 1)[0])


def normals(seed: int, n: int) -> np.ndarray:
    """Standard normal values by Box-Muller over pairs of the stream."""
    m = (n + 1) // 2
    u = (splitmix(seed, 2 * m) >> U(11)).astype(np.float64) / 2.0**53
    r = np.sqrt(-2 * np.log(np.maximum(u[0::2], 2.0**-53)))
    t = 2 * math.pi * u[1::2]
    return np.stack([r * np.cos(t), r * np.sin(t)], 1).ravel()[:n]


def _phi(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


@cache
def codebook(bits: int) -> np.ndarray:
    """The 2**bits centroids that least distort a standard normal value."""
    k = 1 << bits
    c = np.linspace(-1, 1, k) * min(4.5, 1 + bits) if k > 1 else np.zeros(1)
    for _ in range(20_000):
        edge = [-40.0, *((c[1:] + c[:-1]) / 2).tolist(), 40.0]
        mass = [max(_cdf(b) - _cdf(a), 1e-300) for a, b in zip(edge, edge[1:], strict=False)]
        new = np.array([(_phi(a) - _phi(b)) / m for a, b, m in zip(edge, edge[1:], mass, strict=False)])
        if np.abs(new - c).max() < 1e-12:
            return new
        c = c + 1.0 * (new - c)
    return c


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    y = x.copy()
    while h < n:
        y = y.reshape(len(x), -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2)
        h *= 2
    return y.reshape(len(x), n) / math.sqrt(n)


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes as little-endian bit strings."""
    flat = ((codes[:, :, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(len(codes), -1)
    return np.packbits(flat, axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, n: int, bits: int) -> np.ndarray:
    flat = np.unpackbits(packed, axis=1, count=n * bits, bitorder="little").reshape(len(packed), n, bits)
    return (flat.astype(np.int64) << np.arange(bits)).sum(2)


@dataclass(frozen=True)
class Quantizer:
    """``bits`` for each coordinate: bits - 1 of the codebook and one of the residual's sign."""

    dims: int
    bits: int = 4
    seed: int = STORE_SEED

    @cached_property
    def width(self) -> int:
        return 1 << max(0, (self.dims - 1).bit_length())

    @cached_property
    def signs(self) -> np.ndarray:
        return np.where((splitmix(salted(self.seed, SALT_SIGNS), 3 * self.width) >> U(63)).astype(bool), -1.0, 1.0).reshape(3, -1)

    @cached_property
    def projection(self) -> np.ndarray:
        return normals(salted(self.seed, SALT_PROJECTION), self.width**2).reshape(self.width, self.width)

    def centroids(self, bits: int) -> np.ndarray:
        return codebook(bits) / math.sqrt(self.width)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : self.dims] = x
        for s in self.signs:
            y = hadamard(y * s)
        return y

    def unrotate(self, y: np.ndarray) -> np.ndarray:
        for s in self.signs[::-1]:
            y = hadamard(y) * s
        return y[:, : self.dims]

    def _codes(self, y: np.ndarray, bits: int) -> np.ndarray:
        c = self.centroids(bits)
        return np.searchsorted((c[1:] + c[:-1]) / 2, y, "left")

    def mse_encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes of all ``bits`` and exact norms."""
        size = np.linalg.norm(x, axis=1)
        return pack_bits(self._codes(self.rotate(x / np.where(size == 0, 1, size)[:, None]), self.bits), self.bits), size

    def mse_decode(self, packed: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.unrotate(self.centroids(self.bits)[unpack_bits(packed, self.width, self.bits)]) * size[:, None]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed codes and signs, residual norms, norms."""
        size = np.linalg.norm(x, axis=1)
        y = self.rotate(x / np.where(size == 0, 1, size)[:, None])
        codes = self._codes(y, self.bits - 1) if self.bits > 1 else np.zeros(y.shape, np.int64)
        rest = y - self.centroids(self.bits - 1)[codes]
        sign = (rest @ self.projection.T >= 0).astype(np.int64)
        packed = np.concatenate([pack_bits(codes, self.bits - 1) if self.bits > 1 else np.zeros((len(x), 0), np.uint8), pack_bits(sign, 1)], 1)
        return packed, np.linalg.norm(rest, axis=1), size

    def _parts(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = (self.width * (self.bits - 1) + 7) // 8
        codes = unpack_bits(packed[:, :cut], self.width, self.bits - 1) if self.bits > 1 else np.zeros((len(packed), self.width), np.int64)
        return self.centroids(self.bits - 1)[codes], 2.0 * unpack_bits(packed[:, cut:], self.width, 1) - 1

    def decode(self, packed: np.ndarray, rest: np.ndarray, size: np.ndarray) -> np.ndarray:
        y, sign = self._parts(packed)
        y = y + math.sqrt(math.pi / 2) / self.width * rest[:, None] * (sign @ self.projection)
        return self.unrotate(y) * size[:, None]

    def products(self, packed: np.ndarray, rest: np.ndarray, size: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Estimated inner products with a query, without decoding."""
        q = self.rotate(np.asarray(query, np.float64)[None, :])[0]
        y, sign = self._parts(packed)
        return (y @ q + math.sqrt(math.pi / 2) / self.width * rest * (sign @ (self.projection @ q))) * size

    def products_many(self, packed: np.ndarray, rest: np.ndarray, size: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The same with many queries, a row each; codes are unpacked once."""
        q = self.rotate(np.asarray(queries, np.float64))
        y, sign = self._parts(packed)
        return (q @ y.T + math.sqrt(math.pi / 2) / self.width * rest * ((q @ self.projection.T) @ sign.T)) * size


def quantize(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """entity_id, code, rest, size: the compact table that searches scan."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, quantizer.dims))
            packed, rest, size = quantizer.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column("entity_id"), pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(rest.astype(np.float32)), pa.array(size.astype(np.float32))], names=["entity_id", "code", "rest", "size"])

    return vectors.select("entity_id", "embedding").mapInArrow(run, "entity_id long, code binary, rest float, size float")


def search(codes: DataFrame, quantizer: Quantizer, query: Sequence[float], k: int, metric: str = "cos") -> DataFrame:
    """entity_id, score of the nearest by estimated products and exact norms."""
    import pyarrow as pa

    q = np.asarray(query, np.float64)
    own = float(np.linalg.norm(q))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in batch.column("code")])
            size = batch.column("size").to_numpy().astype(np.float64)
            ip = quantizer.products(packed, batch.column("rest").to_numpy().astype(np.float64), size, q)
            if metric == "cos":
                d = np.where(size * own == 0, 1.0, 1 - ip / np.where(size * own == 0, 1, size * own))
            else:
                d = 1 - ip if metric == "ip" else np.maximum(0, size**2 + own**2 - 2 * ip)
            yield pa.RecordBatch.from_arrays([batch.column("entity_id"), pa.array(np.round(d, 6))], names=["entity_id", "score"])

    return codes.mapInArrow(run, "entity_id long, score double").orderBy("score", "entity_id").limit(k)


@dataclass(frozen=True)
class CodeIndex:
    """Stored codes, scanned for the nearest by estimate, and the vectors, of which the best are read for the exact distance.

    A search takes ``wider`` times as many by estimate as are asked for.  Changes are dead ids and further tables of codes.
    """

    codes: DataFrame  # entity_id, code, rest, size
    vectors: DataFrame  # entity_id, embedding
    quantizer: Quantizer
    metric: str
    wider: int = 8
    kind = "turboquant"

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """entity_id, score of the nearest; distances are exact."""
        best = [r["entity_id"] for r in search(self.codes, self.quantizer, query, k * self.wider, self.metric).collect()]  # at most 100 * wider rows
        return knn(self.vectors.filter(F.col("entity_id").isin(*best)), query, k, self.metric)

    def search_many(self, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
        """query_id, entity_id, score, rank for each of ``queries`` (query_id, embedding): a block of codes is decoded once for a block of queries."""
        asked = stored(packed(queries, "query_id", block).toDF("q_ids", "q_matrix", "q_dims"), "queries")
        quantizer, metric = self.quantizer, self.metric

        def score(row: dict):
            q_ids, q = unpacked(row["q_ids"], row["q_matrix"], row["q_dims"])
            codes = np.frombuffer(row["codes"], np.uint8).reshape(row["n"], -1)
            rest, size = (np.frombuffer(row[c], "<f4").astype(np.float64) for c in ("rest", "size"))
            ip = quantizer.products_many(codes, rest, size, q)
            return q_ids, np.frombuffer(row["ids"], "<i8"), _distances(ip, size, np.linalg.norm(q, axis=1), metric)

        wide = best_of(_packed_codes(self.codes).crossJoin(asked), k * self.wider, score)
        pairs = wide.select("query_id", "entity_id").join(self.vectors.select("entity_id", "embedding"), "entity_id")
        exact = pairs.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
        found = exact.select("query_id", "entity_id", F.round(distance(F.col("embedding"), F.col("q"), metric), 6).alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "entity_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    def remove(self, ids: DataFrame) -> CodeIndex:
        gone = ids.select("entity_id")
        return replace(self, codes=self.codes.join(gone, "entity_id", "left_anti"), vectors=self.vectors.join(gone, "entity_id", "left_anti"))

    def upsert(self, vectors: DataFrame) -> CodeIndex:
        rest = self.remove(vectors)
        new = stored(quantize(vectors, self.quantizer), "codes")
        return replace(rest, codes=rest.codes.unionByName(new), vectors=rest.vectors.unionByName(vectors.select("entity_id", "embedding")))


def _distances(ip: np.ndarray, size: np.ndarray, own: np.ndarray, metric: str) -> np.ndarray:
    """Of products (a row for each query) with vectors and queries of these norms."""
    if metric == "ip":
        return 1 - ip
    if metric == "l2sq":
        return np.maximum(0, size[None, :] ** 2 + own[:, None] ** 2 - 2 * ip)
    both = own[:, None] * size[None, :]
    return np.where(both == 0, 1.0, 1 - ip / np.where(both == 0, 1, both))


def _packed_codes(codes: DataFrame) -> DataFrame:
    """Codes in blocks, a row for each Arrow batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = [batch.column("entity_id").to_numpy().astype("<i8"), *(batch.column(c).to_numpy().astype("<f4") for c in ("rest", "size"))]
                raw = b"".join(batch.column("code").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([raw], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["n", "codes", "ids", "rest", "size"])

    return codes.select("entity_id", "code", "rest", "size").mapInArrow(run, "n int, codes binary, ids binary, rest binary, size binary")


def code_index(vectors: DataFrame, quantizer: Quantizer, metric: str = "cos", wider: int = 8) -> CodeIndex:
    """Codes of all vectors, written once."""
    own = vectors.select("entity_id", "embedding").filter("embedding is not null")
    return CodeIndex(stored(quantize(own, quantizer), "codes"), own, quantizer, metric, wider)


def store_quantizer(dims: int, bits: int = 4) -> Quantizer:
    """The quantizer of a vector store, which takes 384 to 1,536 dimensions."""
    if not MIN_DIMS <= dims <= MAX_DIMS:
        raise ValueError(f"a quantized store takes {MIN_DIMS} to {MAX_DIMS} dimensions")
    return Quantizer(dims, bits)


__all__ = ["CodeIndex", "Quantizer", "code_index", "codebook", "quantize", "search", "splitmix", "store_quantizer"]
