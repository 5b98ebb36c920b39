"""Hierarchical navigable small worlds: a proximity graph for each shard of the vectors, searched greedily.

Shards are dealt by a hash of the vectors' ids and built where they meet, in an Arrow task; there are sixteen, so that a search costs
little more in a larger table, unless they get smaller than ``_LEAST`` or larger than ``SHARD`` vectors: every node has a
level, drawn from a hash of its id with geometric chances; on each level a node is linked to near nodes of that level that are nearer to it than
to any neighbour chosen before (the diversity rule), and back.  A shard is one row: ids, vectors, and for each level the links.

A search goes down greedily to the lowest level and keeps there the best ``ef`` nodes in a heap, until the nearest node not
yet followed is farther than all of them.  Every shard is asked and the best of all are merged, so recall is that of a shard.  Removed
vectors are marks beside the shards: walked through, never returned; new ones are shards of their own until ``rebuilt``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .blocks import best_of, matrix_distance, matrix_of, packed, unpacked
from .vector import clamp_k

SHARD = 1 << 18
#: How many shards there are as long as they have between ``_LEAST`` and ``SHARD`` / 2 vectors; a search asks them all.
_SHARDS_MEANT, _LEAST = 16, 2048
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 96
_BLOCK = 512
#: Vectors of a shard up to which near ones are found by comparing all; the others are put in by searching those before.
_ALL = 4096
#: Nodes that a search of all shards keeps more for each doubling of a shard beyond ``_ALL``, as recall would fall.
_MORE = 40
#: Searches that go side by side, and nodes that each follows in a step.
_SIDE, _STEP = 128, 4


def levels_of(ids: np.ndarray, links: int) -> np.ndarray:
    """Geometric levels, the same for an id on every build."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    share = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(links)).astype(np.int64)


def _chosen(order: np.ndarray, near: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Of candidates by distance those nearer to the node than to any chosen before, filled up by the nearest others."""
    out: list[int] = []
    rest: list[int] = []
    for j, d in zip(order.tolist(), near.tolist(), strict=True):
        if len(out) == most:
            break
        (out if not out or (among[j, out] > d).all() else rest).append(j)
    return out + rest[: most - len(out)]


class Near:
    """Distances from queries to chosen rows, of vectors made ready once."""

    def __init__(self, v: np.ndarray, metric: str) -> None:
        self.metric = metric
        self.v = self.ready(v).astype(np.float32)
        self.size = (self.v**2).sum(1) if metric == "l2sq" else None

    def ready(self, v: np.ndarray) -> np.ndarray:
        if self.metric != "cos":
            return v
        size = np.linalg.norm(v, axis=1)[:, None]
        return v / np.where(size == 0, 1, size)

    def of(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each query (ready) to its own row; for ``l2sq`` less the query's square, which changes no order."""
        ip = np.einsum("ij,ij->i", q, self.v[rows])
        return self.size[rows] - 2 * ip if self.size is not None else 1 - ip


def _beam(near: Near, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and distances of the ``ef`` best found from ``start`` (a node each) along ``links`` (-1: none), unsorted, for all queries side by side."""
    n, step = len(q), min(_STEP, ef)
    seen = np.zeros((n, len(links)), bool)
    node, dist, done = np.full((n, ef), -1, np.int32), np.full((n, ef), np.inf, np.float32), np.ones((n, ef), bool)
    node[:, 0], dist[:, 0], done[:, 0] = start, near.of(q, start), False
    seen[np.arange(n), start] = True
    on = np.arange(n)
    while len(on):
        open_ = np.where(done[on], np.inf, dist[on])
        at = np.argpartition(open_, step - 1, axis=1)[:, :step]
        rows = on[:, None]
        ok = np.isfinite(np.take_along_axis(open_, at, 1))
        on, at, rows, ok = (x[ok.any(1)] for x in (on, at, rows, ok))
        done[rows, at] = True
        to = np.where(ok[:, :, None], links[node[rows, at]], -1).reshape(len(on), links.shape[1] * step)
        to.sort(axis=1)
        new = to >= 0
        new[:, 1:] &= to[:, 1:] != to[:, :-1]
        new &= ~seen[rows, to]
        i, j = np.nonzero(new)
        seen[on[i], to[i, j]] = True
        d = np.full(to.shape, np.inf, np.float32)
        d[i, j] = near.of(q[on[i]], to[i, j])
        all_d = np.concatenate([dist[on], d], axis=1)
        best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[on] = np.take_along_axis(all_d, best, 1)
        node[on] = np.take_along_axis(np.concatenate([node[on], to], axis=1), best, 1)
        done[on] = np.take_along_axis(np.concatenate([done[on], ~new], axis=1), best, 1)
    return np.where(np.isfinite(dist), node, -1), dist


def _grown(v: np.ndarray, metric: str, most: int, ef: int) -> list[np.ndarray]:
    """As ``_linked``, for many rows: in an order by chance, each is linked to diverse rows of those found by a search of the ones before.

    Parts of an eighth of what is there are put in at once.
    """
    n = len(v)
    order = np.random.default_rng(n).permutation(n)
    v, near = v[order], Near(v[order], metric)
    links = np.full((n, most), -1, np.int32)
    for i, own in enumerate(_linked(v[:_ALL], metric, most, ef)):
        links[i, : len(own)] = own
    gates = np.arange(min(256, _ALL))

    def diverse(i: int, own: np.ndarray, most: int) -> np.ndarray:
        d = matrix_distance(v[i : i + 1], v[own], metric)[0]
        by = np.argsort(d, kind="stable")
        own, d = own[by], d[by]
        return own[_chosen(np.arange(len(own)), d, matrix_distance(v[own], v[own], metric), most)]

    size = _ALL
    while size < n:
        end, back = min(n, size + size // 8), {}
        for a in range(size, end, _SIDE):
            b = min(end, a + _SIDE)
            start = gates[matrix_distance(near.v[a:b], near.v[gates], "l2sq" if metric == "l2sq" else "ip").argmin(1)]
            found, _ = _beam(near, links[:size], near.v[a:b], start, ef)
            for i, own in zip(range(a, b), found, strict=True):
                own = diverse(i, own[own >= 0], most // 2)
                links[i, : len(own)] = own
                for j in own.tolist():
                    back.setdefault(j, []).append(i)
        for j, more in back.items():
            own = np.concatenate([links[j][links[j] >= 0], np.array(more, np.int32)])
            own = own if len(own) <= most else diverse(j, own, most)
            links[j] = -1
            links[j, : len(own)] = own
        size = end
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for i, own in zip(order.tolist(), links, strict=True):
        out[i] = order[own[own >= 0]].astype(np.int32)
    return out


def _linked(v: np.ndarray, metric: str, most: int, ef: int) -> list[np.ndarray]:
    """Neighbours of every row: diverse near rows, and back, ``most`` at most."""
    n, want = len(v), min(ef, len(v) - 1)
    if want <= 0:
        return [np.zeros(0, np.int32) for _ in range(n)]
    links: list[set[int]] = [set() for _ in range(n)]
    nearest: list[np.ndarray] = []
    for a in range(0, n, _BLOCK):
        d = matrix_distance(v[a : a + _BLOCK], v, metric)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        top = np.argpartition(d, want - 1, axis=1)[:, :want]
        dist = np.take_along_axis(d, top, 1)
        by = np.argsort(dist, axis=1, kind="stable")
        top, dist = np.take_along_axis(top, by, 1), np.take_along_axis(dist, by, 1)
        nearest += list(top)
        for i in range(len(d)):
            among = matrix_distance(v[top[i]], v[top[i]], metric)
            for j in _chosen(np.arange(want), dist[i], among, most // 2):
                links[a + i].add(int(top[i, j]))
    for i in range(n):
        for j in list(links[i]):
            links[j].add(i)
    out = []
    for i in range(n):
        own = np.fromiter(links[i], np.int32, len(links[i]))
        if len(own) > most:
            d = matrix_distance(v[i : i + 1], v[own], metric)[0]
            by = np.argsort(d, kind="stable")
            own = own[by][_chosen(np.arange(len(own)), d[by], matrix_distance(v[own[by]], v[own[by]], metric), most)]
        out.append(own)
    return out


def build(ids: np.ndarray, v: np.ndarray, metric: str, links: int = LINKS, ef: int = EF_BUILD) -> bytes:
    """Links of all levels: for each level its nodes, offsets and neighbours; the first node of the top level is the entry."""
    level = levels_of(ids, links)
    parts = []
    for k in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= k).astype(np.int32)
        near = (_linked if len(nodes) <= _ALL else _grown)(v[nodes], metric, 2 * links if k == 0 else links, ef)
        flat = nodes[np.concatenate(near)] if near else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype("<i4")
        parts.append(struct.pack("<ii", len(nodes), len(flat)) + nodes.astype("<i4").tobytes() + offsets.tobytes() + flat.astype("<i4").tobytes())
    return struct.pack("<i", len(parts)) + b"".join(parts)


class World:
    """A shard, read from its row."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, graph: bytes, metric: str) -> None:
        self.ids, self.v, self.metric, self.levels = ids, v, metric, []
        (n,), at = struct.unpack_from("<i", graph), 4
        for _ in range(n):
            nodes, flat = struct.unpack_from("<ii", graph, at)
            place = np.frombuffer(graph, "<i4", nodes, at + 8)
            offsets = np.frombuffer(graph, "<i4", nodes + 1, at + 8 + 4 * nodes)
            near = np.frombuffer(graph, "<i4", flat, at + 12 + 8 * nodes)
            row = np.full(len(ids), -1, np.int32)
            row[place] = np.arange(nodes)
            self.levels.append((row, offsets, near))
            at += 12 + 8 * nodes + 4 * flat
        self.entry = int(place[0]) if len(ids) else -1

    def search_many(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and distances of the ``ef`` best nodes found for each query, nearest first."""
        ef = min(ef, len(self.ids))
        place, d = np.full((len(q), ef), -1), np.full((len(q), ef), np.inf)
        if self.entry < 0:
            return place, d
        near = Near(self.v, self.metric)
        tables = []
        for row, offsets, to in self.levels:
            size = np.diff(offsets)
            table = np.full((len(self.ids), max(1, int(size.max(initial=0)))), -1, np.int32)
            nodes = np.repeat(np.flatnonzero(row >= 0), size)
            table[nodes, np.arange(len(to)) - np.repeat(offsets[:-1], size)] = to
            tables.append(table)
        for a in range(0, len(q), _SIDE):
            part = q[a : a + _SIDE]
            own = near.ready(part).astype(np.float32)
            at = np.full(len(part), self.entry)
            for table in tables[:0:-1]:
                node, dist = _beam(near, table, own, at, 1)
                at = node[:, 0]
            node, _ = _beam(near, tables[0], own, at, ef)
            for i, x in enumerate(node):
                x = x[x >= 0]
                exact = matrix_distance(part[i : i + 1], self.v[x], self.metric)[0]
                by = np.argsort(exact, kind="stable")
                place[a + i, : len(x)], d[a + i, : len(x)] = x[by], exact[by]
        return place, d

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """Distance and place of the ``ef`` best nodes found."""
        place, d = self.search_many(q[None], ef)
        return [(float(x), int(j)) for x, j in zip(d[0], place[0], strict=True) if j >= 0]


_SHARDS = "shard long, ids binary, matrix binary, dims int, graph binary"


def _shards(vectors: DataFrame, metric: str, links: int, ef: int, most: int) -> DataFrame:
    rows = vectors.select("entity_id", "embedding").filter("embedding is not null")
    count = rows.count()
    n = max(1, -(-count // max(1, min(most // 2, max(_LEAST, -(-count // _SHARDS_MEANT))))))  # a hash deals unevenly: half full on average

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            ids, v = (np.concatenate(x) for x in zip(*parts, strict=True))
            for i in range(0, len(ids), most):
                own, w = ids[i : i + most], v[i : i + most]
                row = [pa.array([shard]), pa.array([own.astype("<i8").tobytes()], pa.binary()), pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([w.shape[1]], pa.int32()), pa.array([build(own, w.astype(np.float64), metric, links, ef)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=["shard", "ids", "matrix", "dims", "graph"])

        here, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, ids, v = batch.column("shard").to_numpy(), batch.column("entity_id").to_numpy(), matrix_of(batch.column("embedding"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if shard[a] != here:
                    if parts:
                        yield from out(here, parts)
                    here, parts = int(shard[a]), []
                parts.append((ids[a:b], v[a:b]))
        if parts:
            yield from out(here, parts)

    tasks = min(n, max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 64))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("entity_id"), F.lit(n))).repartitionByRange(tasks, "shard").sortWithinPartitions("shard", "entity_id")
    return stored(dealt.select("shard", "entity_id", "embedding").mapInArrow(run, _SHARDS), "worlds")


@dataclass(frozen=True)
class HnswIndex:
    shards: DataFrame
    metric: str
    links: int = LINKS
    ef_build: int = EF_BUILD
    most: int = SHARD
    dead: DataFrame | None = None  # entity_id, shards_before: marks for the shards that were there then
    added: tuple[DataFrame, ...] = ()
    kind = "hnsw"

    def _parts(self) -> list[tuple[DataFrame, DataFrame | None]]:
        """Tables of shards, each with the marks set after it was made."""
        marks = [None if self.dead is None else self.dead.filter(F.col("part") >= i).select("entity_id") for i in range(len(self.added) + 1)]
        return list(zip((self.shards, *self.added), marks, strict=True))

    def search_many(self, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
        """query_id, entity_id, score, rank of the ``k`` nearest found for each of ``queries`` (query_id, embedding)."""
        asked = stored(packed(queries, "query_id", 2048).toDF("q_ids", "q_matrix", "q_dims"), "queries")
        metric, out = self.metric, None
        for shards, marks in self._parts():

            def score(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                ids, v = unpacked(row["ids"], row["matrix"], row["dims"])
                q_ids, q = unpacked(row["q_ids"], row["q_matrix"], row["q_dims"])
                world, gone = World(ids, v, row["graph"], metric), np.frombuffer(row["gone"], "<i8") if row.get("gone") else None
                place, d = world.search_many(q, ef + int(_MORE * max(0.0, np.log2(len(ids) / _ALL))))
                found = np.where(place >= 0, ids[place], -1)
                if gone is not None:
                    d[np.isin(found, gone)] = np.inf
                return q_ids, found, d

            rows = shards
            if marks is not None:
                rows = _marked(shards, marks)
            # written here, with few bytes in an Arrow batch: a shard is a large row
            part = stored(best_of(rows.crossJoin(asked), k, score).drop("rank"), "found")
            out = part if out is None else out.unionByName(part)
        return _ranked(out, k)

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """entity_id, score of the nearest found."""
        asked = self.shards.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, embedding array<float>")
        return self.search_many(asked, clamp_k(k), max(EF_SEARCH, clamp_k(k))).select("entity_id", "score").orderBy("score", "entity_id")

    def remove(self, ids: DataFrame) -> HnswIndex:
        gone = ids.select("entity_id", F.lit(len(self.added)).alias("part"))
        return replace(self, dead=stored(gone if self.dead is None else self.dead.unionByName(gone), "world-marks"))

    def bulk_load(self, vectors: DataFrame) -> HnswIndex:
        """Vectors whose ids are not in it: shards of their own."""
        return replace(self, added=(*self.added, _shards(vectors, self.metric, self.links, self.ef_build, self.most)))

    def upsert(self, vectors: DataFrame) -> HnswIndex:
        return self.remove(vectors.select("entity_id")).bulk_load(vectors)


def _marked(shards: DataFrame, marks: DataFrame) -> DataFrame:
    """Shards with ``gone``: the marked ids that they have, found by joining the ids alone."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own)), pa.array(own)], names=["key", "entity_id"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [np.array(x, "<i8").tobytes() for x in batch.column("gone").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.binary())], names=["key", "gone"])

    keyed = shards.withColumn("key", F.xxhash64("ids"))
    flat = keyed.select("key", "ids").mapInArrow(ids_of, "key long, entity_id long").join(marks.distinct(), "entity_id", "left_semi")
    # a shard's marks are at most as many as its vectors
    gone = flat.groupBy("key").agg(F.collect_list("entity_id").alias("gone")).mapInArrow(gather, "key long, gone binary")
    return keyed.join(gone, "key", "left").drop("key")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "entity_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def train(vectors: DataFrame, metric: str = "cos", links: int = LINKS, ef_build: int = EF_BUILD, most: int = SHARD) -> HnswIndex:
    return HnswIndex(_shards(vectors, metric, links, ef_build, most), metric, links, ef_build, most)
