"""The canonical graph over the test tables, in Spark and as SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inverted import build_text_index
from .store import KG, PARTS, lay_out, shared_dir

#: table, key column, id offset, name prefix, type (SQL expression), observation columns
NODES = (
    ("region", "r_regionkey", 1, "region:", "'region'", ("r_name",)),
    ("nation", "n_nationkey", 100, "nation:", "'nation'", ("n_name",)),
    ("supplier", "s_suppkey", 1_000_000, "supplier:", "'supplier'", ("s_name",)),
    ("customer", "c_custkey", 2_000_000, "customer:", "'customer'", ("c_name", "c_mktsegment")),
    ("part", "p_partkey", 3_000_000, "part:", "'part'", ("p_name", "p_brand", "p_type")),
    ("orders", "o_orderkey", 10_000_000, "order:", "'order'", ("o_orderpriority",)),
    ("documents", "doc_id", 50_000_000, "doc:", "concat('doc:', lang)", ("text",)),
    ("embeddings", "vec_id", 60_000_000, "vec:", "concat('label:', cast(label as varchar(9)))", ()),
)
#: table, from key and offset, to key and offset, type, whether rows repeat
EDGES = (
    ("nation", "n_nationkey", 100, "n_regionkey", 1, "in_region", False),
    ("supplier", "s_suppkey", 1_000_000, "s_nationkey", 100, "in_nation", False),
    ("customer", "c_custkey", 2_000_000, "c_nationkey", 100, "in_nation", False),
    ("orders", "o_orderkey", 10_000_000, "o_custkey", 2_000_000, "placed_by", False),
    ("lineitem", "l_orderkey", 10_000_000, "l_partkey", 3_000_000, "contains", True),
    ("lineitem", "l_partkey", 3_000_000, "l_suppkey", 1_000_000, "supplied_by", True),
)


_READ: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is looked up once a session."""
    key = (f"{spark.sparkContext.applicationId} {id(spark)}", f"{sf_dir}/{name}.parquet")
    if key not in _READ:
        _READ[key] = spark.read.parquet(key[1])
    return _READ[key]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _id(key: str, offset: int) -> Column:
    return F.col(key).cast("long") + F.lit(offset).cast("long")


def canonical(spark: SparkSession, sf_dir: str, tables: set[str] | None = None) -> KG:
    """The graph of all tables, or of those in ``tables`` (nodes and edges that they hold)."""

    def own(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    nodes = [n for n in NODES if tables is None or n[0] in tables]
    e = [own(t).select(_id(k, o).alias("id"), F.concat(F.lit(p), F.col(k).cast("string")).alias("name"), F.expr(kind.replace("varchar(9)", "string")).alias("type")) for t, k, o, p, kind, _ in nodes]
    o = [own(t).select(_id(k, off).alias("entity_id"), F.lit(i).cast("long").alias("idx"), F.col(c).alias("body")) for t, k, off, _, _, cs in nodes for i, c in enumerate(cs)]
    r = []
    for t, a, x, b, y, kind, repeats in EDGES:
        if tables is None or t in tables:
            rows = own(t).select(_id(a, x).alias("from_id"), _id(b, y).alias("to_id"), F.lit(kind).alias("type"))
            r.append(rows.distinct() if repeats else rows)
    v = own("embeddings").select(_id("vec_id", 60_000_000).alias("entity_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit("").alias("model"))
    none = spark.createDataFrame([], "entity_id long, idx long, body string")
    return KG(_union(e), _union(o) if o else none, _union(r) if r else spark.createDataFrame([], "from_id long, to_id long, type string"), v)


_LAID: dict[tuple, tuple[KG, set[str]]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the files behind a folder's tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, names = [], {n for n, *_ in NODES} | {t for t, *_ in EDGES}
    for s in fs.listStatus(path):
        if s.getPath().getName().removesuffix(".parquet") in names:
            parts = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
            out += [(p.getPath().toString(), p.getLen(), p.getModificationTime()) for p in parts]
    return tuple(sorted(out))


def _key(spark: SparkSession, sf_dir: str, make) -> tuple:
    return f"{spark.sparkContext.applicationId} {id(spark)}", make.__name__, _state(spark, sf_dir)


def laid_out(spark: SparkSession, sf_dir: str, make=None, parts: Sequence[str] = PARTS) -> KG:
    """``canonical`` (or the graph that ``make`` gives) with a layout: each of ``parts`` is written once a session while the tables stay the same.

    The other tables are there too, unsorted where nothing has asked for them yet.
    """
    make = make or canonical
    key = _key(spark, sf_dir, make)
    kg, done = _LAID.get(key) or (make(spark, sf_dir), set())
    missing = [p for p in parts if p not in done]
    if missing or kg.layout is None:
        kg = lay_out(kg, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}", parts=missing)
        _LAID[key] = kg, done | set(missing)
    return kg


def indexed(spark: SparkSession, sf_dir: str, make=None, parts: Sequence[str] = PARTS) -> KG:
    """``laid_out`` with a text index, built once too."""
    kg = laid_out(spark, sf_dir, make, parts)
    if kg.text is None:
        key = _key(spark, sf_dir, make or canonical)
        kg = kg.with_(text=build_text_index(kg, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"))
        _LAID[key] = kg, _LAID[key][1]
    return kg


def document_graph(spark: SparkSession, sf_dir: str) -> KG:
    """Documents with the vector of the same number, each citing the ones at half and a third of its number."""
    docs = table(spark, sf_dir, "documents")
    kg = canonical(spark, sf_dir, {"documents"})
    vectors = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left_semi")
    key = F.col("doc_id").cast("long")
    cites = _union([docs.filter(key >= d).select((key + 50_000_000).alias("from_id"), (F.floor(key / d) + 50_000_000).alias("to_id"), F.lit("cites").alias("type")) for d in (2, 3)])
    return kg.with_(
        relations=cites,
        embeddings=vectors.select((F.col("vec_id").cast("long") + 50_000_000).alias("entity_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.lit("").alias("model")),
    )


#: Sources made of documents, three languages in turn: K is the document's number, P its half, J its rest by 7, TEXT its text.
CODE = (
    ("rs", "/*TEXT*/\npub struct TK {\n    a: u32,\n}\npub fn fK(x: u32) -> u32 {\n    let s = \"} fn no(\";\n    fP(x)\n}\nimpl SJ for TK {\n    fn gK(&self) -> u32 { fK(1) }\n}\n"),
    ("ts", "/*TEXT*/\nexport class TK implements SJ {\n  gK(): number {\n    return fP(1);\n  }\n}\nexport function fK(x: number): number {\n  const s = `} function no(`;\n  return x;\n}\n"),
    ("py", '"""TEXT"""\nclass TK(object):\n    def gK(self, x):\n        return fP(x)\n\ndef fK(x):\n    s = "def no("\n    return x\n'),
)
_TRAITS = 7


def code_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, content: a source file for each document, its text in a comment; the first files of the first language also define traits."""
    key = F.col("doc_id").cast("long")
    names = {"K": key, "P": F.floor(key / 2), "J": key % _TRAITS}
    body = F.translate(F.coalesce("text", F.lit("")), '*"\\\r\x00`', "+'/  '")

    def made(template: str) -> Column:
        parts = re.split(r"(TEXT|(?<=[a-zA-Z])[KPJ]\b|(?<=[a-zA-Z])[KPJ](?=[(<]))", template)
        return F.concat(*(body if x == "TEXT" else names[x].cast("string") if x in names else F.lit(x) for x in parts))

    content = F.lit(None).cast("string")
    for i, (_, template) in enumerate(CODE):
        trait = F.when(key < len(CODE) * _TRAITS, F.concat(F.lit("pub trait S"), F.floor(key / len(CODE)).cast("string"), F.lit(" { }\n"))).otherwise("") if i == 0 else F.lit("")
        content = F.when(key % len(CODE) == i, F.concat(made(template), trait)).otherwise(content)
    suffix = F.element_at(F.array(*(F.lit(x) for x, _ in CODE)), (key % len(CODE) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), key.cast("string"), F.lit("."), suffix).alias("file"), content.cast("binary").alias("content"))


#: Symbols Y (k, qualified, kind, name, lang, a, b: lines) and edges L ("from", "to", type) of ``code_tree``.
CODE_SQL = """D AS (SELECT doc_id AS k, doc_id // 2 AS p, doc_id % 7 AS j, doc_id % 3 AS m, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS n,
            concat('src/f', doc_id, '.', ['rs', 'ts', 'py'][doc_id % 3 + 1]) AS file, ['rust', 'typescript', 'python'][doc_id % 3 + 1] AS lang FROM documents),
    Y AS (SELECT k, file, lang, concat(file, '::T', k) AS qualified, 'class' AS kind, concat('T', k) AS name, n + 2 AS a, n + [4, 6, 4][m + 1] AS b FROM D
          UNION ALL SELECT k, file, lang, concat(file, '::f', k), 'function', concat('f', k), n + [5, 7, 6][m + 1], n + [8, 10, 8][m + 1] FROM D
          UNION ALL SELECT k, file, lang, concat(file, '::g', k), 'method', concat('g', k), n + [10, 3, 3][m + 1], n + [10, 5, 4][m + 1] FROM D
          UNION ALL SELECT k, file, lang, concat(file, '::S', k // 3), 'class', concat('S', k // 3), n + 12, n + 12 FROM D WHERE m = 0 AND k < 21),
    U AS (SELECT concat(file, CASE m WHEN 0 THEN '::f' ELSE '::g' END, k) AS src, concat('f', p) AS target, 'calls' AS type FROM D
          UNION ALL SELECT concat(file, '::g', k), concat('f', k), 'calls' FROM D WHERE m = 0
          UNION ALL SELECT CASE m WHEN 0 THEN file ELSE concat(file, '::T', k) END, concat('S', j), 'references' FROM D WHERE m < 2),
    L AS (SELECT file AS "from", qualified AS "to", 'defines' AS type FROM Y UNION ALL SELECT DISTINCT src, qualified, type FROM U JOIN Y ON Y.name = U.target WHERE src <> qualified)"""


def _sql_parts() -> str:
    e = " UNION ALL ".join(f"SELECT {o} + CAST({k} AS BIGINT) AS id, concat('{p}', {k}) AS name, {kind} AS type FROM {t}" for t, k, o, p, kind, _ in NODES)
    o = " UNION ALL ".join(f"SELECT {off} + CAST({k} AS BIGINT) AS entity_id, CAST({i} AS BIGINT) AS idx, {c} AS body FROM {t}" for t, k, off, _, _, cs in NODES for i, c in enumerate(cs))
    r = " UNION ALL ".join(f"SELECT {'DISTINCT ' if d else ''}{x} + CAST({a} AS BIGINT) AS from_id, {y} + CAST({b} AS BIGINT) AS to_id, '{kind}' AS type FROM {t}" for t, a, x, b, y, kind, d in EDGES)
    return f"E AS ({e}), O AS ({o}), R AS ({r}), V AS (SELECT 60000000 + vec_id AS entity_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"


#: Common table expressions E, O, R, V of the canonical graph.
GRAPH_SQL = _sql_parts()
#: The same of ``document_graph``.
DOCUMENT_SQL = """E AS (SELECT 50000000 + doc_id AS id, concat('doc:', doc_id) AS name, concat('doc:', lang) AS type FROM documents),
    O AS (SELECT 50000000 + doc_id AS entity_id, CAST(0 AS BIGINT) AS idx, text AS body FROM documents),
    R AS (SELECT 50000000 + doc_id AS from_id, 50000000 + doc_id // 2 AS to_id, 'cites' AS type FROM documents WHERE doc_id >= 2
          UNION ALL SELECT 50000000 + doc_id, 50000000 + doc_id // 3, 'cites' FROM documents WHERE doc_id >= 3),
    V AS (SELECT 50000000 + vec_id AS entity_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))"""
