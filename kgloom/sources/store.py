"""The graph as DataFrames, its Parquet layout, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = "id long, name string, type string"
OBSERVATIONS = "entity_id long, idx long, body string"
RELATIONS = "from_id long, to_id long, type string"
EMBEDDINGS = "entity_id long, embedding array<float>, model string"

_OWN: list[str] = []

#: Arrow batches between Spark and its Python workers are bounded in rows only; both hold several at once.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that driver and executors share.

    Only where the session has none set (a local session, as in tests) a folder on this machine is made.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="kgloom-"))
        found = _OWN[0]
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches as ``stored`` does, for frames that the caller writes; a bound that is set stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there.  With ``by`` its values are folders of their own."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_BATCH, None)
    conf.set(_BATCH, str(_BATCH_BYTES))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        conf.unset(_BATCH) if before is None else conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Point operations look ids up first and filter by them; beyond this many they join.
FEW = 1000


@dataclass(frozen=True)
class Layout:
    """Second orders of a written graph, so that each lookup has files sorted by what it asks for.

    by_id: the entities by id (``entities`` are by name); incoming: the relations by to_id (``relations`` are by from_id).  Either is the
    graph's own table where that isn't laid out.
    """

    by_id: DataFrame
    incoming: DataFrame


@dataclass(frozen=True)
class KG:
    """entities (id, name, type), observations (entity_id, idx, body), relations (from_id, to_id, type), embeddings (entity_id, embedding, model).

    A graph that was written by ``lay_out`` has a ``layout``, one whose words are indexed a ``text`` index, one whose
    vectors are indexed a vector ``index``; a change drops those that it makes wrong.
    """

    entities: DataFrame
    observations: DataFrame
    relations: DataFrame
    embeddings: DataFrame
    layout: Layout | None = None
    text: Any = None
    index: Any = None

    def with_(self, **parts: Any) -> KG:
        changed = set(parts)
        if changed & {"entities", "observations", "relations"}:
            parts.setdefault("layout", None)
        if changed & {"entities", "observations"}:
            parts.setdefault("text", None)
        if "embeddings" in changed:
            parts.setdefault("index", None)
        return replace(self, **parts)

    def chosen(self, names: Sequence[str]) -> tuple[DataFrame, list[int] | None]:
        """id, name, type of the entities of these names; and their ids, if the graph has a layout and they are few."""
        wanted = sorted(set(names))
        if self.layout is None or not len(wanted) <= FEW:
            asked = self.entities.sparkSession.createDataFrame([(n,) for n in wanted], "name string")
            return self.entities.join(F.broadcast(asked), "name", "left_semi").select("id", "name", "type"), None
        found = self.entities.filter(F.col("name").isin(*wanted)).select("id", "name", "type").take(FEW + 1) if wanted else []
        if len(found) > FEW:  # names that are no keys
            return self.entities.filter(F.col("name").isin(*wanted)).select("id", "name", "type"), None
        return self.entities.sparkSession.createDataFrame(found, "id long, name string, type string"), sorted({r["id"] for r in found})

    def few(self, ids: DataFrame, column: str = "id") -> list[int] | None:
        """The ids of a frame, if the graph has a layout and they are few."""
        if self.layout is None:
            return None
        found = ids.select(column).take(FEW + 1)
        return None if len(found) > FEW else sorted({r[0] for r in found})

    def nested(self, entities: DataFrame | None = None, ids: list[int] | None = None) -> DataFrame:
        """id, name, type, observations (in idx order) of ``entities``, all by default; ``ids`` are theirs, where known."""
        chosen = self.entities if entities is None else entities
        if ids is not None:
            own = self.observations.filter(F.col("entity_id").isin(*ids))
        else:
            own = self.observations if entities is None else self.observations.join(chosen.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        lists = own.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("o"))
        bodies = F.coalesce(F.transform("o", lambda x: x["body"]), F.array().cast("array<string>"))
        return chosen.join(lists, chosen["id"] == lists["entity_id"], "left").select("id", "name", "type", bodies.alias("observations"))

    def leaving(self, ids: list[int]) -> DataFrame:
        """Relations from these entities."""
        return self.relations.filter(F.col("from_id").isin(*ids)).select("from_id", "to_id", "type")

    def entering(self, ids: list[int]) -> DataFrame:
        """Relations to these entities."""
        rows = self.relations if self.layout is None else self.layout.incoming
        return rows.filter(F.col("to_id").isin(*ids)).select("from_id", "to_id", "type")

    def name_of(self, ids: list[int] | None) -> DataFrame:
        """id, name, type of these entities (all where None)."""
        rows = self.entities if self.layout is None else self.layout.by_id
        return (rows if ids is None else rows.filter(F.col("id").isin(*ids))).select("id", "name", "type")

    def edges(self, relations: DataFrame | None = None, ends: list[int] | None = None) -> DataFrame:
        """from_id, to_id, from, to, relation_type: relations with their names; ``ends`` are all their ends, where known."""
        r = self.relations if relations is None else relations
        e = self.name_of(ends)
        f = e.select(F.col("id").alias("from_id"), F.col("name").alias("from"))
        t = e.select(F.col("id").alias("to_id"), F.col("name").alias("to"))
        return r.join(f, "from_id").join(t, "to_id").select("from_id", "to_id", "from", "to", F.col("type").alias("relation_type"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        for name in ("entities", "observations", "relations", "embeddings"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    def compact(self, path: str, files: int | None = None) -> KG:
        """``lay_out``."""
        return lay_out(self, path, files)


def _written(df: DataFrame, path: str, key: str, files: int | None, *looked_up: str) -> DataFrame:
    """``df`` sorted by ``key`` in files with Bloom filters on the columns that are looked up."""
    dealt = df.repartitionByRange(*([files] if files else []), key).sortWithinPartitions(key)
    writer = dealt.write.option("parquet.block.size", 16 << 20)
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", 1 << 17)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PARTS = ("entities", "relations", "observations", "embeddings")


def lay_out(kg: KG, path: str, files: int | None = None, parts: Sequence[str] = PARTS) -> KG:
    """A copy whose tables are sorted by what point operations ask for, with Bloom filters: a lookup reads the row groups that can have it.

    Entities and relations are written in two orders.  Tables that are not among ``parts`` stay as they are.
    """
    schemas = dict(zip(PARTS, (ENTITIES, RELATIONS, OBSERVATIONS, EMBEDDINGS), strict=True))
    keys = dict(zip(PARTS, ("name", "from_id", "entity_id", "entity_id"), strict=True))
    laid = {}
    for part in parts:
        rows = getattr(kg, part).select(*(f.split()[0] for f in schemas[part].split(", ")))
        laid[part] = _written(rows, f"{path}/{part}", keys[part], files, keys[part])
    layout = kg.layout or Layout(kg.entities, kg.relations)
    if "entities" in laid:
        layout = replace(layout, by_id=_written(laid["entities"], f"{path}/entities_by_id", "id", files, "id"))
    if "relations" in laid:
        layout = replace(layout, incoming=_written(laid["relations"], f"{path}/relations_by_to", "to_id", files, "to_id"))
    return replace(kg, **laid, layout=layout)


def empty(spark: SparkSession) -> KG:
    return KG(*(spark.createDataFrame([], s) for s in (ENTITIES, OBSERVATIONS, RELATIONS, EMBEDDINGS)))


def load(spark: SparkSession, path: str) -> KG:
    return KG(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("entities", ENTITIES), ("observations", OBSERVATIONS), ("relations", RELATIONS), ("embeddings", EMBEDDINGS))))


def build(spark: SparkSession, entities: list[tuple[str, str, list[str]]], relations: list[tuple[str, str, str]] = (), embeddings: dict[str, list[float]] | None = None) -> KG:
    """A graph from plain values, ids in the given order from 1."""
    ids = {n: i for i, (n, _, _) in enumerate(entities, 1)}
    return KG(
        spark.createDataFrame([(ids[n], n, t) for n, t, _ in entities], ENTITIES),
        spark.createDataFrame([(ids[n], i, b) for n, _, o in entities for i, b in enumerate(o)], OBSERVATIONS),
        spark.createDataFrame([(ids[a], ids[b], t) for a, b, t in relations], RELATIONS),
        spark.createDataFrame([(ids[n], [float(x) for x in v], "") for n, v in (embeddings or {}).items()], EMBEDDINGS),
    )


def to_blob(column: str = "embedding") -> Column:
    """Vector as the exchange blob: u32 LE dimension, then f32 LE values."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype("<u4")
        values = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), "<f4").view(np.uint8)
        # the dimension goes before the values, all rows in one buffer
        ends = np.cumsum(4 + 4 * size.astype(np.int64))
        starts = ends - 4 - 4 * size
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        is_head = np.zeros(len(out), bool)
        is_head[(starts[:, None] + np.arange(4)).ravel()] = True
        out[is_head], out[~is_head] = size.view(np.uint8), values
        return _binaries(out, np.append(starts, ends[-1] if len(ends) else 0), v)

    return pack(F.col(column))


def _binaries(data: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    """Binary values between offsets, null where ``like`` is."""
    made = pa.Array.from_buffers(pa.large_binary(), len(like), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return pc.if_else(pc.is_valid(like), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def from_blob(column: str) -> Column:
    """Vector of an exchange blob; a blob shorter than it says is an error."""

    @F.arrow_udf("array<float>")
    def unpack(v: pa.Array) -> pa.Array:
        there = v.drop_null().cast(pa.large_binary())
        _, places, data = there.buffers()
        at = np.frombuffer(places, np.int64)[there.offset : there.offset + len(there) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        if (np.diff(at) < 4).any():
            raise ValueError("short embedding blob")
        size = raw[at[:-1, None] + np.arange(4)].copy().view("<u4")[:, 0].astype(np.int64) if len(there) else np.zeros(0, np.int64)
        if (np.diff(at) < 4 + 4 * size).any():
            raise ValueError("short embedding blob")
        ends = np.cumsum(size)
        # bytes of the values: from four after each blob's start
        source = np.repeat(at[:-1] + 4 - 4 * (ends - size), 4 * size) + np.arange(4 * size.sum())
        own = np.zeros(len(v), np.int64)
        own[np.flatnonzero(pc.is_valid(v).to_numpy(zero_copy_only=False))] = size
        offsets = pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32(), mask=np.append(pc.is_null(v).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(raw[source].view("<f4")))

    return unpack(F.col(column))
