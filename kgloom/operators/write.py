"""Batch writes: each takes a graph and gives a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import KG, stored
from .read import NotFound

MAX_NAME = 1024
MAX_BODY = 65_536
MAX_BATCH = 1000


def validate_name(name: str, what: str = "name") -> str:
    if not name or len(name.encode()) > MAX_NAME:
        raise ValueError(f"{what} must be 1 to {MAX_NAME} bytes")
    return name


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` (from 1) in an order."""
    # a request has at most MAX_BATCH rows and a bulk load is numbered by ranges, so no large window runs in one task; the ranges are
    # written, as two plans over them would be dealt into different ones
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(before, "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def _number(rows: DataFrame, after: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ids that follow the greatest of ``after`` (one row: m)."""
    return number(rows, order).crossJoin(F.broadcast(after)).withColumn("id", F.coalesce("m", F.lit(0)) + F.col("place")).drop("place", "m")


def create_entities(kg: KG, new: DataFrame) -> tuple[KG, DataFrame]:
    """Add entities (pos, name, type, observations) whose name is new; of equal names in the batch the first counts.

    Also returns what was created: id, name, type, observations.
    """
    first = new.filter("name <> ''").withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).filter("r = 1").drop("r")
    fresh = first.join(kg.entities.select("name"), "name", "left_anti")
    created = _number(fresh, kg.entities.agg(F.max("id").alias("m")), ["pos", "name"]).select("id", "name", "type", "observations")
    bodies = created.select(F.col("id").alias("entity_id"), F.posexplode("observations").alias("i", "body")).select("entity_id", F.col("i").cast("long").alias("idx"), "body")
    return kg.with_(entities=kg.entities.select("id", "name", "type").unionByName(created.select("id", "name", "type")), observations=kg.observations.select("entity_id", "idx", "body").unionByName(bodies)), created


def create_relations(kg: KG, new: DataFrame) -> tuple[KG, DataFrame]:
    """Add relations (from, to, type) whose ends exist and that are not there yet; returns those created too."""
    ids = kg.entities.select("id", "name")
    named = new.join(ids.select(F.col("name").alias("from"), F.col("id").alias("from_id")), "from").join(ids.select(F.col("name").alias("to"), F.col("id").alias("to_id")), "to")
    created = named.dropDuplicates(["from_id", "to_id", "type"]).join(kg.relations.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_anti")
    rows = created.select("from_id", "to_id", "type")
    return kg.with_(relations=kg.relations.select("from_id", "to_id", "type").unionByName(rows)), created.select("from", "to", "type")


def _must_exist(kg: KG, names: DataFrame) -> None:
    missing = names.join(kg.entities.select("name"), "name", "left_anti").first()
    if missing:
        raise NotFound(f"Entity '{missing['name']}' not found")


def _append(kg: KG, rows: DataFrame) -> DataFrame:
    """Observations with ``rows`` (entity_id, pos, body) after each entity's last."""
    last = kg.observations.join(rows.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.max("idx").alias("m"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("pos"))
    added = rows.withColumn("r", place).join(last, "entity_id", "left").select("entity_id", (F.coalesce("m", F.lit(-1).cast("long")) + F.col("r")).alias("idx"), "body")
    return kg.observations.select("entity_id", "idx", "body").unionByName(added)


def add_observations(kg: KG, new: DataFrame, dedup: bool = False, strict: bool = True) -> KG:
    """Append observations (pos, name, body) in their order; equal ones too, unless ``dedup``."""
    if strict:
        _must_exist(kg, new.select("name").distinct())
    rows = new.join(kg.entities.select("name", F.col("id").alias("entity_id")), "name").select("entity_id", "pos", "body")
    if dedup:
        rows = rows.join(kg.observations.select("entity_id", "body"), ["entity_id", "body"], "left_anti").groupBy("entity_id", "body").agg(F.min("pos").alias("pos"))
    return kg.with_(observations=_append(kg, rows.select("entity_id", "pos", "body")))


def _without(kg: KG, gone: DataFrame) -> KG:
    """``kg`` without the entities of ``gone`` (id) and all that hangs on them."""
    of = lambda c: gone.select(F.col("id").alias(c))
    return KG(
        kg.entities.join(gone.select("id"), "id", "left_anti").select("id", "name", "type"),
        kg.observations.join(of("entity_id"), "entity_id", "left_anti").select("entity_id", "idx", "body"),
        kg.relations.join(of("from_id"), "from_id", "left_anti").join(of("to_id"), "to_id", "left_anti").select("from_id", "to_id", "type"),
        kg.embeddings.join(of("entity_id"), "entity_id", "left_anti").select("entity_id", "embedding", "model"),
    )


def delete_entities(kg: KG, names: DataFrame) -> KG:
    return _without(kg, kg.entities.join(names.select("name").distinct(), "name", "left_semi").select("id"))


def delete_observations(kg: KG, gone: DataFrame, strict: bool = True) -> KG:
    """Delete all observations equal to those given (name, body) of the entity."""
    if strict:
        _must_exist(kg, gone.select("name").distinct())
    rows = gone.join(kg.entities.select("name", F.col("id").alias("entity_id")), "name").select("entity_id", "body")
    return kg.with_(observations=kg.observations.join(rows, ["entity_id", "body"], "left_anti").select("entity_id", "idx", "body"))


def delete_relations(kg: KG, gone: DataFrame) -> KG:
    """Delete exact relations (from, to, type); unknown ones are ignored."""
    ids = kg.entities.select("id", "name")
    rows = gone.join(ids.select(F.col("name").alias("from"), F.col("id").alias("from_id")), "from").join(ids.select(F.col("name").alias("to"), F.col("id").alias("to_id")), "to")
    return kg.with_(relations=kg.relations.join(rows.select("from_id", "to_id", "type"), ["from_id", "to_id", "type"], "left_anti").select("from_id", "to_id", "type"))


def upsert_entities(kg: KG, new: DataFrame) -> KG:
    """Create entities (pos, name, type, observations), or set the type and append the observations that are new.

    Observations are held against those there before, not against each other.
    """
    grown, created = create_entities(kg, new)
    again = new.join(created.select("name"), "name", "left_anti")
    types = again.groupBy("name").agg(F.max_by("type", "pos").alias("new_type"))
    entities = grown.entities.join(types, "name", "left").select("id", "name", F.coalesce("new_type", "type").alias("type"))
    bodies = again.join(kg.entities.select("name", F.col("id").alias("entity_id")), "name").select("entity_id", "pos", F.posexplode("observations").alias("i", "body"))
    fresh = bodies.join(kg.observations.select("entity_id", "body"), ["entity_id", "body"], "left_anti").select("entity_id", (F.col("pos") * (1 << 20) + F.col("i")).alias("pos"), "body")
    return grown.with_(entities=entities, observations=_append(grown, fresh))


def merge_entities(kg: KG, source: str, target: str, strict_reference: bool = False) -> KG:
    """Move the source's observations and relations to the target and delete the source.

    Relations become unique and those between the two go, unless ``strict_reference``, which keeps repeats and
    turns them into self-loops.
    """
    if source == target:
        return kg
    found = {r["name"]: r["id"] for r in kg.entities.filter(F.col("name").isin(source, target)).select("name", "id").collect()}
    for name in (source, target):
        if name not in found:
            raise NotFound(f"Entity '{name}' not found")
    s, t = found[source], found[target]
    rows = kg.observations.filter(F.col("entity_id") == s).select(F.lit(t).cast("long").alias("entity_id"), F.col("idx").alias("pos"), "body")
    moved = lambda c: F.when(F.col(c) == s, F.lit(t).cast("long")).otherwise(F.col(c)).alias(c)
    touched = F.col("from_id").isin(s, t) | F.col("to_id").isin(s, t)
    old = kg.relations.select("from_id", "to_id", "type")
    between = ((F.col("from_id") == s) & (F.col("to_id") == t)) | ((F.col("from_id") == t) & (F.col("to_id") == s))
    near = old.filter(touched) if strict_reference else old.filter(touched & ~between)
    near = near.select(moved("from_id"), moved("to_id"), "type")
    relations = old.filter(~touched).unionByName(near if strict_reference else near.distinct())
    joined = kg.with_(observations=_append(kg, rows), relations=relations)
    gone = kg.entities.filter(F.col("id") == s).select("id")
    return _without(joined, gone)


def wipe(kg: KG) -> KG:
    return KG(*(df.limit(0) for df in (kg.entities, kg.observations, kg.relations, kg.embeddings)))
