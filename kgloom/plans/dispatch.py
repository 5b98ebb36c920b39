"""The operations by name: argument checks, categories, and one call for each."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import code, hnsw, ivf, read, text, traverse, turboquant, vector, write
from ..sources.inverted import BODY, NAME, build_text_index
from ..sources.store import KG, shared_dir, stored
from ..streaming import watch

READ, WRITE, VECTOR, CODE = "read", "write", "vector", "code"
MAX_ITEMS = 1000


class UnknownOperation(KeyError):
    """No operation of that name, or its category is not enabled."""


def _names(args: dict, key: str = "names", truncate: bool = True) -> list[str]:
    names = args.get(key)
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError(f"{key} must be a list of strings")
    if len(names) > MAX_ITEMS and not truncate:
        raise ValueError(f"{key} has over {MAX_ITEMS} items")
    return names[:MAX_ITEMS]


def _text(args: dict, key: str, default: str | None = None) -> str:
    value = args.get(key, default)
    if not isinstance(value, str):
        raise ValueError(f"{key} must be a string")
    return value


def _number(args: dict, key: str, default: int) -> int:
    value = args.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{key} must be a number from 0")
    return value


def _vector(args: dict, key: str = "embedding") -> list[float]:
    value = args.get(key)
    if not isinstance(value, list):
        raise ValueError(f"{key} must be a list of numbers")
    return vector.parse_embedding(value)


class Session:
    """A graph and the operations on it; writes replace the graph of the session.

    After ``settle`` writes its tables are written to the shared folder, so that plans do not grow with the writes.
    """

    def __init__(self, kg: KG, categories: Sequence[str] = (READ, WRITE, VECTOR, CODE), metric: str = "cos", projects: dict[str, KG] | None = None, index_kind: str = "hnsw", settle: int = 4) -> None:
        self.kg, self.categories, self.metric = kg, set(categories), metric
        self.projects = projects or {}
        self.index_kind = index_kind
        self.boost = False
        self.settle, self._writes = settle, 0

    @property
    def spark(self) -> SparkSession:
        return self.kg.entities.sparkSession

    def call(self, name: str, args: dict[str, Any] | None = None) -> Any:
        """The operation's result: DataFrames (entities and relations as a pair), or a value of a write."""
        if name not in OPERATIONS or OPERATIONS[name][0] not in self.categories:
            raise UnknownOperation(name)
        before = self.kg
        result = OPERATIONS[name][1](self, args or {})
        if self.kg is not before and name != "compact":
            self._writes += 1
            if self._writes % self.settle == 0:
                parts = ("entities", "observations", "relations", "embeddings")
                same = {t for t in parts if getattr(self.kg, t) is getattr(before, t)} if self.settle == 1 else set()
                self.kg = replace(self.kg, **{t: stored(getattr(self.kg, t), f"session-{t}") for t in parts if t not in same})
        return result

    def frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def project(self, args: dict) -> KG:
        name = _project_name(args)
        if name not in self.projects:
            raise ValueError(f"project '{name}' is not indexed")
        return self.projects[name]


OPERATIONS: dict[str, tuple[str, Callable[[Session, dict], Any]]] = {}


def _operation(category: str):
    def add(f):
        OPERATIONS[f.__name__] = category, f
        return f

    return add


def _entities(s: Session, args: dict) -> DataFrame:
    rows = args.get("entities")
    if not isinstance(rows, list) or len(rows) > MAX_ITEMS:
        raise ValueError(f"entities must be a list of at most {MAX_ITEMS}")
    out = []
    for i, e in enumerate(rows):
        bodies = e.get("observations", [])
        if len(bodies) > MAX_ITEMS or any(len(b.encode()) > write.MAX_BODY for b in bodies):
            raise ValueError("too many or too long observations")
        out.append((i, write.validate_name(e["name"]), write.validate_name(e["entityType"], "entityType"), list(bodies)))
    return s.frame(out, "pos long, name string, type string, observations array<string>")


def _triples(s: Session, args: dict) -> DataFrame:
    rows = args.get("relations")
    if not isinstance(rows, list) or len(rows) > MAX_ITEMS:
        raise ValueError(f"relations must be a list of at most {MAX_ITEMS}")
    return s.frame([(r["from"], r["to"], write.validate_name(r["relationType"], "relationType")) for r in rows], "`from` string, `to` string, type string")


def _texts(rows: DataFrame, source: str, key: str, column: str) -> DataFrame:
    idx = F.col("idx") if "idx" in rows.columns else F.lit(0)
    return rows.select(F.lit(source).alias("source"), F.col(key).alias("entity_id"), idx.cast("long").alias("idx"), F.col(column).alias("text"))


@_operation(WRITE)
def create_entities(s, a):
    index = s.kg.text
    s.kg, created = write.create_entities(s.kg, _entities(s, a))
    if index is not None:  # what is new goes into a segment of its own
        created = stored(created, "created")
        bodies = created.select("id", F.posexplode("observations").alias("idx", "body"))
        s.kg = s.kg.with_(text=index.insert(_texts(created, NAME, "id", "name").unionByName(_texts(bodies, BODY, "id", "body"))))
    return created


@_operation(WRITE)
def create_relations(s, a):
    s.kg, created = write.create_relations(s.kg, _triples(s, a))
    return created


@_operation(WRITE)
def add_observations(s, a):
    rows = [(i, j, o["entityName"], b) for i, o in enumerate(a["observations"]) for j, b in enumerate(o["contents"])]
    old = s.kg
    s.kg = write.add_observations(s.kg, s.frame([(i * (1 << 20) + j, n, b) for i, j, n, b in rows], "pos long, name string, body string"))
    if old.text is not None:
        few = old.chosen(sorted({r[2] for r in rows}))[0].select(F.col("id").alias("entity_id"))
        own = s.kg.observations.join(few, "entity_id", "left_semi").select("entity_id", "idx", "body")
        new = own.join(old.observations.select("entity_id", "idx"), ["entity_id", "idx"], "left_anti")
        s.kg = s.kg.with_(text=old.text.insert(_texts(new, BODY, "entity_id", "body")))
    return len(rows)


@_operation(WRITE)
def delete_entities(s, a):
    names, old = _names(a, "entityNames"), s.kg
    s.kg = write.delete_entities(s.kg, s.frame([(n,) for n in names], "name string"))
    if old.text is not None:
        s.kg = s.kg.with_(text=old.text.delete_entities(stored(old.chosen(names)[0].select("id"), "gone")))


@_operation(WRITE)
def delete_observations(s, a):
    rows = [(o["entityName"], b) for o in a["deletions"] for b in o["observations"]]
    s.kg = write.delete_observations(s.kg, s.frame(rows, "name string, body string"))


@_operation(WRITE)
def delete_relations(s, a):
    s.kg = write.delete_relations(s.kg, _triples(s, a))


@_operation(WRITE)
def upsert_entities(s, a):
    new = _entities(s, a)
    s.kg = write.upsert_entities(s.kg, new)
    return s.kg.nested(s.kg.entities.join(new.select("name"), "name", "left_semi"))


@_operation(WRITE)
def merge_entities(s, a):
    s.kg = write.merge_entities(s.kg, _text(a, "source"), _text(a, "target"))
    return read.get_entity(s.kg, a["target"])


@_operation(WRITE)
def compact(s, a):
    """The graph in a written layout, its words indexed anew."""
    path = f"{shared_dir(s.spark)}/compact-{uuid.uuid4().hex}"
    laid = s.kg.compact(path)
    s.kg = laid.with_(text=build_text_index(laid, f"{path}/text"), index=s.kg.index)


@_operation(READ)
def read_graph(s, a):
    return read.read_graph(s.kg, a.get("entityType") or None, _number(a, "offset", 0), _number(a, "limit", 1000))


@_operation(READ)
def search_nodes(s, a):
    return text.search_nodes(s.kg, _text(a, "query"), a.get("entityType") or None, _number(a, "offset", 0), _number(a, "limit", 20))


@_operation(READ)
def open_nodes(s, a):
    return read.open_nodes(s.kg, _names(a))


@_operation(READ)
def get_entity(s, a):
    read.need(s.kg, _text(a, "name"))
    return read.get_entity(s.kg, a["name"])


@_operation(READ)
def describe_entity(s, a):
    read.need(s.kg, _text(a, "name"))
    return read.describe_entity(s.kg, a["name"])


@_operation(READ)
def batch_get_entities(s, a):
    return read.batch_get_entities(s.kg, _names(a))


@_operation(READ)
def entity_exists(s, a):
    return read.entity_exists(s.kg, _names(a))


@_operation(READ)
def graph_stats(s, a):
    return read.graph_stats(s.kg)


@_operation(READ)
def search_relations(s, a):
    return read.search_relations(s.kg, a.get("from"), a.get("to"), a.get("relationType"))


@_operation(READ)
def find_path(s, a):
    return traverse.find_path(s.kg, _text(a, "from"), _text(a, "to"))


@_operation(READ)
def find_all_paths(s, a):
    return traverse.find_all_paths(s.kg, _text(a, "from"), _text(a, "to"), _number(a, "maxDepth", 6), _number(a, "maxPaths", 50))


@_operation(READ)
def get_neighbors(s, a):
    return traverse.get_neighbors(s.kg, _text(a, "name"), a.get("direction", "BOTH"), a.get("relationType") or None, _number(a, "depth", 1))


@_operation(READ)
def extract_subgraph(s, a):
    return traverse.extract_subgraph(s.kg, _names(a), _number(a, "depth", 1))


@_operation(READ)
def degree(s, a):
    read.need(s.kg, _text(a, "name"))
    return read.degree(s.kg, a["name"], a.get("direction", "BOTH"))


@_operation(READ)
def list_entity_types(s, a):
    return read.list_entity_types(s.kg)


@_operation(READ)
def list_relation_types(s, a):
    return read.list_relation_types(s.kg)


@_operation(READ)
def export_graph(s, a):
    return read.export_json(s.kg)


@_operation(VECTOR)
def vector_upsert_embedding(s, a):
    s.kg = vector.upsert_embedding(s.kg, _text(a, "entityName"), _vector(a), a.get("model", ""))


@_operation(VECTOR)
def vector_batch_upsert(s, a):
    items = a["items"]
    if len(items) > vector.MAX_ITEMS:
        raise ValueError(f"items has over {vector.MAX_ITEMS} items")
    rows = [(i, x["entityName"], [float(v) for v in x["embedding"]], x.get("model", "")) for i, x in enumerate(items)]
    s.kg, outcome = vector.batch_upsert(s.kg, s.frame(rows, "pos long, name string, embedding array<float>, model string"))
    return outcome


@_operation(VECTOR)
def vector_get_embedding(s, a):
    return vector.get_embedding(s.kg, _text(a, "entityName"))


@_operation(VECTOR)
def vector_delete_embedding(s, a):
    s.kg, had = vector.delete_embedding(s.kg, _text(a, "entityName"))
    return had


@_operation(VECTOR)
def vector_search_entities(s, a):
    return vector.search_entities(s.kg, _vector(a), _number(a, "topK", 10), a.get("entityType") or None, s.metric)


@_operation(VECTOR)
def vector_search_by_entity(s, a):
    return vector.search_by_entity(s.kg, _text(a, "entityName"), _number(a, "topK", 10), a.get("entityType") or None, a.get("excludeSelf", True), s.metric)


@_operation(VECTOR)
def vector_recommend(s, a):
    return vector.recommend(s.kg, _names(a, "positive"), a.get("negative") or [], _number(a, "topK", 10), a.get("entityType") or None, s.metric)


@_operation(VECTOR)
def vector_mmr_search(s, a):
    return vector.mmr_search(s.kg, _vector(a), _number(a, "topK", 10), a.get("fetchK"), float(a.get("lambda", 0.5)), a.get("entityType") or None, s.metric)


@_operation(VECTOR)
def hybrid_search(s, a):
    return vector.hybrid_search(s.kg, _text(a, "queryText"), _vector(a, "queryEmbedding"), float(a.get("textWeight", 0.5)), float(a.get("vecWeight", 0.5)), _number(a, "topK", 10), s.boost, s.metric)


@_operation(VECTOR)
def vector_reindex(s, a):
    """Trains the session's kind of index over all vectors; searches use it from then on."""
    vectors = s.kg.embeddings
    if s.index_kind == "ivf":
        index = ivf.train(vectors, metric=s.metric).save(f"{shared_dir(s.spark)}/cells-{uuid.uuid4().hex}")
    elif s.index_kind == "turboquant":
        dims = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
        index = turboquant.code_index(vectors, turboquant.Quantizer(dims, 4), s.metric)
    else:
        index = hnsw.train(vectors, s.metric)
    s.kg = s.kg.with_(index=index)
    return s.kg.embeddings.agg(F.lit(True).alias("reindexed"), F.lit(index.kind).alias("index_kind"), F.count(F.lit(1)).alias("embeddings"))


@_operation(VECTOR)
def vector_refresh_graph_cache(s, a):
    s.boost = True
    return vector.graph_cache_stats(s.kg)


@_operation(VECTOR)
def vector_store_stats(s, a):
    return vector.store_stats(s.kg)


def _project_name(a: dict) -> str:
    name = a.get("project", "default")
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
        raise ValueError("project must be 1 to 64 letters, digits, _ or -")
    return name


def _take_up(s: Session, name: str, found: DataFrame, links: DataFrame, gone: DataFrame | None = None) -> None:
    """The project's graph with files that changed, written once so that plans stay short."""
    kg = code.merged(s.projects.get(name), stored(found, "symbols"), stored(links, "links"), gone)
    s.projects[name] = KG(*(stored(getattr(kg, t), f"code-{t}") for t in ("entities", "observations", "relations", "embeddings")))


@_operation(CODE)
def code_index(s, a):
    name = _project_name(a)
    old = s.projects.get(name)
    found, links, tally = code.code_index(code.read_files(s.spark, _text(a, "path")), None if old is None else code.known_files(old), a.get("force", False))
    tally = stored(tally, "tally")
    _take_up(s, name, found, links)
    return tally


@_operation(CODE)
def code_watch(s, a):
    name = _project_name(a)

    def keep(found, links, tally, gone):
        _take_up(s, name, found, links, gone)

    return watch.code_watch(s.spark, _text(a, "path"), keep, f"{shared_dir(s.spark)}/watch-{uuid.uuid4().hex}")


@_operation(CODE)
def code_outline(s, a):
    return code.code_outline(s.project(a), _text(a, "file"))


@_operation(CODE)
def code_search(s, a):
    return code.code_search(s.project(a), _text(a, "query"), a.get("kind"), a.get("lang"), _number(a, "limit", 20))


@_operation(CODE)
def code_get_symbol(s, a):
    return code.code_get_symbol(s.project(a), _text(a, "name"))


@_operation(CODE)
def code_embed(s, a):
    rows = [(i, x["name"], [float(v) for v in x["embedding"]]) for i, x in enumerate(a["items"][:MAX_ITEMS])]
    name = a.get("project", "default")
    s.projects[name], outcome = code.code_embed(s.project(a), s.frame(rows, "pos long, name string, embedding array<float>"))
    return outcome


@_operation(CODE)
def code_semantic_search(s, a):
    return code.code_semantic_search(s.project(a), _vector(a), a.get("kind"), a.get("lang"), _number(a, "limit", 20))
