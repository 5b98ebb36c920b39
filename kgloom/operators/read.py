"""Lookups, pages, relation filters and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KG

MAX_RELATIONS = 1000
MAX_PAGE = 1000


class NotFound(ValueError):
    """A name that must exist does not."""


def _names(kg: KG, names: Sequence[str]) -> DataFrame:
    return kg.entities.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, name string")


def need(kg: KG, name: str) -> int:
    row = kg.entities.filter(F.col("name") == name).select("id").first()
    if row is None:
        raise NotFound(f"Entity '{name}' not found")
    return row["id"]


def get_entity(kg: KG, name: str) -> DataFrame:
    """name, type, observations of one entity; no row where there is none."""
    return kg.nested(*kg.chosen([name])).select("name", "type", "observations")


describe_entity = get_entity


def _around(kg: KG, rows: DataFrame, ids: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """Relations from, and relations to, the chosen entities."""
    if ids is not None:
        return kg.leaving(ids), kg.entering(ids)
    own = rows.select("id")
    return (kg.relations.join(own, F.col(end) == F.col("id"), "left_semi").select("from_id", "to_id", "type") for end in ("from_id", "to_id"))


def describe_bundle(kg: KG, name: str) -> DataFrame:
    """An entity with its degree and number of distinct neighbours."""
    rows, ids = kg.chosen([name])
    out, into = _around(kg, rows, ids)
    ends = out.select(F.col("to_id").alias("n")).unionByName(into.select(F.col("from_id").alias("n")))
    degree = ends.agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("n").alias("neighbors"))
    return kg.nested(rows, ids).select("name", "type", "observations").crossJoin(degree)


def batch_get_entities(kg: KG, names: Sequence[str]) -> DataFrame:
    """pos, name, type, observations in the order asked; type is null where the name is unknown."""
    found = kg.nested(*kg.chosen(names))
    return _names(kg, names).join(found.select("name", "type", "observations"), "name", "left").select("pos", "name", "type", "observations").orderBy("pos")


def entity_exists(kg: KG, names: Sequence[str]) -> DataFrame:
    hit = kg.chosen(names)[0].select("name", F.lit(True).alias("hit")).distinct()
    return _names(kg, names).join(hit, "name", "left").select("pos", "name", F.coalesce("hit", F.lit(False)).alias("exists")).orderBy("pos")


def open_nodes(kg: KG, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The named entities, and the relations with either end among them."""
    rows, ids = kg.chosen(names)
    left, right = _around(kg, rows, ids)
    if ids is None:
        right = right.join(rows.select("id"), F.col("from_id") == F.col("id"), "left_anti")
    else:
        right = right.filter(~F.col("from_id").isin(*ids))
    return kg.nested(rows, ids), kg.edges(left.unionByName(right))


def search_relations(kg: KG, source: str | None = None, target: str | None = None, relation_type: str | None = None, limit: int = MAX_RELATIONS) -> DataFrame:
    """from, to, relation_type; filters left out or empty do not apply."""
    r = kg.relations
    froms, tos = (kg.chosen([x]) if x else (None, None) for x in (source, target))
    if tos[1] is not None and froms[1] is None:
        r = kg.entering(tos[1])  # files by to_id
    for (rows, ids), end in ((froms, "from_id"), (tos, "to_id")):
        if ids is not None:
            r = r.filter(F.col(end).isin(*ids))
        elif rows is not None:
            r = r.join(rows.select(F.col("id").alias(end)), end, "left_semi")
    if relation_type:
        r = r.filter(F.col("type") == relation_type)
    # the page is cut before names are looked up: rows without both ends are no relations
    page = r.select("from_id", "to_id", "type").orderBy("from_id", "to_id", "type").limit(min(limit, MAX_RELATIONS))
    ends = None
    if kg.layout is not None:  # a page is bounded: its rows come once, and names are looked up by id
        got = page.collect()
        page = kg.entities.sparkSession.createDataFrame(got, "from_id long, to_id long, type string")
        ends = sorted({x for r in got for x in r[:2]})
    return kg.edges(page, ends).orderBy("from_id", "to_id", "relation_type").select("from", "to", "relation_type")


def page_of(kg: KG, entity_type: str | None, offset: int, limit: int) -> DataFrame:
    e = kg.name_of(None)
    e = e.filter(F.col("type") == entity_type) if entity_type else e
    return e.select("id", "name", "type").orderBy("id").offset(offset).limit(limit)


def read_graph(kg: KG, entity_type: str | None = None, offset: int = 0, limit: int = MAX_PAGE) -> tuple[DataFrame, DataFrame]:
    """A page of entities by id, and the relations with both ends on it."""
    page = page_of(kg, entity_type, offset, min(limit, MAX_PAGE))
    if kg.layout is not None:  # at most MAX_PAGE rows
        got = page.collect()
        page, few = kg.entities.sparkSession.createDataFrame(got, "id long, name string, type string"), [r["id"] for r in got]
        return kg.nested(page, few), kg.edges(kg.leaving(few).filter(F.col("to_id").isin(*few)), few)
    ids = page.select("id")
    inside = kg.relations.join(ids, F.col("from_id") == F.col("id"), "left_semi").join(ids, F.col("to_id") == F.col("id"), "left_semi")
    return kg.nested(page), kg.edges(inside)


def ui_graph(kg: KG, entity_type: str | None = None, offset: int = 0, limit: int = 300) -> DataFrame:
    """A browsing page without bodies: id, name, type, obs_count, has_more."""
    limit = max(1, min(limit, MAX_PAGE))
    more = page_of(kg, entity_type, offset, limit + 1)
    counts = kg.observations.join(more.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy("entity_id").agg(F.count(F.lit(1)).alias("obs_count"))
    has_more = more.agg((F.count(F.lit(1)) > limit).alias("has_more"))
    page = more.orderBy("id").limit(limit)
    return page.join(counts, page["id"] == counts["entity_id"], "left").crossJoin(F.broadcast(has_more)).select("id", "name", "type", F.coalesce("obs_count", F.lit(0).cast("long")).alias("obs_count"), "has_more")


def graph_stats(kg: KG) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(kg.entities, "entities").crossJoin(count(kg.relations, "relations")).crossJoin(count(kg.observations, "observations"))


def list_entity_types(kg: KG) -> DataFrame:
    return kg.entities.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def list_relation_types(kg: KG) -> DataFrame:
    return kg.relations.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def ui_meta(kg: KG) -> DataFrame:
    """Both type lists in one: kind, type, count."""
    return list_entity_types(kg).withColumn("kind", F.lit("entity")).unionByName(list_relation_types(kg).withColumn("kind", F.lit("relation")))


def direction_of(text: str) -> str:
    """'out', 'in' or 'both' of either spelling; anything else is 'both'."""
    return {"outgoing": "out", "out": "out", "incoming": "in", "in": "in"}.get((text or "").lower(), "both")


def degree(kg: KG, name: str, direction: str = "BOTH") -> DataFrame:
    """name, degree; a self-loop counts twice for both directions."""
    return degrees(kg, [name], direction)


def degrees(kg: KG, names: Sequence[str], direction: str = "BOTH") -> DataFrame:
    """name, degree of many entities in one plan; unknown names have no row."""
    way = direction_of(direction)
    own, ids = kg.chosen(names)
    out, into = _around(kg, own, ids)
    ends = []
    if way != "in":
        ends.append(out.select(F.col("from_id").alias("id")))
    if way != "out":
        ends.append(into.select(F.col("to_id").alias("id")))
    rows = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return own.select("id", "name").join(counts, "id", "left").select("name", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def export_graph(kg: KG, max_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """The first entities by id and relations by their ends; negative is unlimited."""
    e, r = kg.entities.orderBy("id"), kg.relations.orderBy("from_id", "to_id", "type")
    if max_rows >= 0:
        e, r = e.limit(max_rows), r.limit(max_rows)
    return kg.nested(e), kg.edges(r)


def export_json(kg: KG, max_rows: int = 1_000_000) -> DataFrame:
    """One JSON document a row: section, json."""
    e, r = export_graph(kg, max_rows)
    entity = F.to_json(F.struct("name", F.col("type").alias("entityType"), "observations"))
    relation = F.to_json(F.struct("from", "to", F.col("relation_type").alias("relationType")))
    return e.select(F.lit("entities").alias("section"), entity.alias("json")).unionByName(r.select(F.lit("relations").alias("section"), relation.alias("json")))


def hydrate(kg: KG, ids: DataFrame) -> DataFrame:
    """id, name, type, observations of the ids of a frame."""
    return kg.nested(kg.entities.join(ids.select("id").distinct(), "id", "left_semi"))
