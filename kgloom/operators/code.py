"""Symbols of source files and the edges between them."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scopes import scan, scan_python
from ..sources.store import KG, stored
from ..sources.tree import language_of, read_tree
from .text import search_ids
from .vector import batch_upsert, clamp_k, nearest

MAX_SYMBOLS = 20_000
SIGNATURE, DOC, SNIPPET = 512, 512, 2000
DIMS = 768


def _short(text: str, most: int) -> str:
    text = text.strip()
    return text if len(text) <= most else text[:most] + "…"


def parse(path: str, text: str) -> tuple[list[dict], list[dict]]:
    """Definitions (kind, name, line_start, line_end, signature, doc, snippet) and references (kind, name, line)."""
    lang = language_of(path)
    if lang is None or not text.strip():
        return [], []
    defs, refs = (scan_python(text) if lang == "python" else None) or scan(text, lang)
    defs, lines = defs[:MAX_SYMBOLS], text.split("\n")
    for d in defs:
        d["signature"] = _short(lines[d["line_start"] - 1], SIGNATURE)
        d["doc"] = _short(next((x for x in d["doc"].splitlines() if x.strip()), ""), DOC)
        d["snippet"] = _short("\n".join(lines[d["line_start"] - 1 : d["line_end"]]), SNIPPET)
    return defs, refs[: MAX_SYMBOLS - len(defs)]


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """file, content of the sources below a folder, by the tree's data source."""
    return read_tree(spark, root)


_SYMBOL = "file string, lang string, hash string, defs array<struct<kind:string,name:string,line_start:int,line_end:int,signature:string,doc:string,snippet:string>>, refs array<struct<kind:string,name:string,line:int>>"


def parse_files(files: DataFrame) -> DataFrame:
    """file, lang, hash, defs, refs of files (file, content)."""
    import pyarrow as pa

    hashed = files.select("file", "content", F.sha2("content", 256).alias("hash"))

    def run(batches):
        for batch in batches:
            rows = []
            for f, c, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                defs, refs = parse(f, (c or b"").decode("utf-8", "replace"))
                rows.append({"file": f, "lang": language_of(f), "hash": h, "defs": defs, "refs": refs})
            if rows:
                d = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("snippet", pa.string())]))
                r = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32())]))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("lang", pa.string()), ("hash", pa.string()), ("defs", d), ("refs", r)]))

    return hashed.mapInArrow(run, _SYMBOL)


def symbols(parsed: DataFrame) -> DataFrame:
    """qualified, file, lang, hash, kind, name, line_start, line_end, signature, doc, snippet; repeats of a name in a file carry their line."""
    flat = parsed.select("file", "lang", "hash", F.posexplode("defs").alias("pos", "d")).select("file", "lang", "hash", "pos", "d.*")
    again = F.row_number().over(Window.partitionBy("file", "name").orderBy("line_start", "pos"))
    q = F.concat("file", F.lit("::"), "name")
    named = flat.withColumn("again", again).withColumn("qualified", F.when(F.col("again") > 1, F.concat(q, F.lit("::L"), F.col("line_start").cast("string"))).otherwise(q))
    return named.select("qualified", "file", "lang", "hash", "kind", "name", "line_start", "line_end", "signature", "doc", "snippet").dropDuplicates(["qualified"])


def _held(batches: Iterator) -> Iterator:
    """Rows (file, line, spot, last, qualified) by file and line, definitions first: each reference with the definition that holds it.

    Definitions that have begun stand in a heap by their length; those that have ended leave it when they come up, so a file
    takes time in proportion to its rows.
    """
    import pyarrow as pa

    here, open_, n = None, [], 0
    for batch in batches:
        out: list[tuple] = []
        for file, line, spot, last, qualified in zip(*(batch.column(c).to_pylist() for c in ("file", "line", "spot", "last", "qualified")), strict=True):
            if file != here:
                here, open_, n = file, [], 0
            if qualified is not None:
                heapq.heappush(open_, (last - line, n, last, qualified))
                n += 1
                continue
            while open_ and open_[0][2] < line:
                heapq.heappop(open_)
            out.append((file, spot, open_[0][3] if open_ else file))
        if out:
            files, spots, holders = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(spots, pa.int32()), pa.array(holders)], names=["file", "spot", "from"])


def edges(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """from, to, type: what files define, and what symbols (or files) call or reference by an unambiguous name."""
    defines = found.select(F.col("file").alias("from"), F.col("qualified").alias("to"), F.lit("defines").alias("type"))
    single = found.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.any_value("qualified").alias("to")).filter("c = 1").select("name", "to")
    refs = parsed.select("file", F.posexplode("refs").alias("spot", "r")).select("file", "spot", "r.*")
    spans = found.select("file", F.col("line_start").alias("line"), F.lit(-1).alias("spot"), F.col("line_end").alias("last"), "qualified")
    none = F.lit(None)
    rows = spans.unionByName(refs.select("file", "line", "spot", none.cast("int").alias("last"), none.cast("string").alias("qualified")))
    swept = rows.repartition("file").sortWithinPartitions("file", "line", "spot", "last", "qualified").mapInArrow(_held, "file string, spot int, `from` string")
    uses = refs.join(swept, ["file", "spot"]).join(single, "name").filter(F.col("from") != F.col("to"))
    return defines.unionByName(uses.select("from", "to", F.when(F.col("kind") == "call", "calls").otherwise("references").alias("type")).distinct())


def code_index(files: DataFrame, before: DataFrame | None = None, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and a tally (files_indexed, files_skipped, files_failed, symbols, relations) of files (file, content).

    ``before`` (file, hash) are files indexed earlier: equal ones are skipped unless ``force``.  A file without content could not be read.
    """
    read = files.filter("content is not null")
    failed = files.filter("content is null")
    hashed = read.select("file", "content", F.sha2("content", 256).alias("hash"))
    if before is not None and not force:
        old = before.select("file", "hash").distinct()
        skipped, fresh = hashed.join(old, ["file", "hash"], "left_semi"), hashed.join(old, ["file", "hash"], "left_anti")
    else:
        skipped, fresh = hashed.limit(0), hashed
    parsed = stored(parse_files(fresh), "parsed")  # each file is parsed once, whatever reads of it follow
    found = symbols(parsed)
    links = edges(parsed, found)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(parsed, "files_indexed"), count(skipped, "files_skipped"), count(failed, "files_failed"), count(found, "symbols"), count(links, "relations")]
    tally = parts[0]
    for part in parts[1:]:
        tally = tally.crossJoin(F.broadcast(part))  # one row each
    return found, links, tally


def as_graph(found: DataFrame, links: DataFrame) -> KG:
    """Symbols and files as a graph: ids by a hash of the name, metadata as 'key: value' observations."""
    ident = lambda c: F.xxhash64(c)
    files = found.select(F.col("file").alias("name"), F.lit("code:file").alias("type"), "lang", "hash").distinct()
    meta = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v"))
    s = found.withColumn("lines", F.concat_ws("-", "line_start", "line_end"))
    own = s.select(ident("qualified").alias("entity_id"), F.array(*(meta(k, k) for k in ("file", "lang", "kind", "name", "lines", "signature", "doc", "snippet"))).alias("m"))
    of_file = files.select(ident("name").alias("entity_id"), F.array(*(meta(k, k) for k in ("lang", "hash"))).alias("m"))
    rows = own.unionByName(of_file).select("entity_id", F.posexplode(F.filter("m", lambda x: F.length(x["v"]) > 0)).alias("i", "x"))
    entities = s.select(ident("qualified").alias("id"), F.col("qualified").alias("name"), F.concat(F.lit("code:"), "kind").alias("type")).unionByName(files.select(ident("name").alias("id"), "name", "type"))
    spark = found.sparkSession
    return KG(
        entities, rows.select("entity_id", F.col("i").cast("long").alias("idx"), F.concat_ws(": ", "x.k", "x.v").alias("body")),
        links.select(ident("from").alias("from_id"), ident("to").alias("to_id"), "type"), spark.createDataFrame([], "entity_id long, embedding array<float>, model string"),
    )


def metadata(kg: KG, entities: DataFrame) -> DataFrame:
    """id, name, type and the metadata of code entities as columns."""
    own = kg.observations.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    pair = F.split("body", ": ", 2)
    kept = ("file", "lang", "kind", "lines", "signature", "doc")
    cols = own.groupBy("entity_id").agg(*(F.max(F.when(pair[0] == k, pair[1])).alias(k) for k in kept))
    return entities.join(cols, entities["id"] == cols["entity_id"], "left").drop("entity_id")


def code_outline(kg: KG, file: str) -> DataFrame:
    """The symbols a file defines, by their first line."""
    start = kg.entities.filter(F.col("name") == file).select(F.col("id").alias("from_id"))
    own = kg.relations.filter(F.col("type") == "defines").join(start, "from_id", "left_semi").select(F.col("to_id").alias("id"))
    rows = metadata(kg, kg.entities.join(own, "id", "left_semi"))
    return rows.select("name", "kind", "lines", "signature").orderBy(F.split("lines", "-")[0].cast("long"), "name")


def code_search(kg: KG, query: str, kind: str | None = None, lang: str | None = None, limit: int = 20) -> DataFrame:
    limit = max(1, min(limit, 500))
    rows = search_ids(kg, query, None, 0, min(5 * limit, 1000)).filter(F.col("type").startswith("code:") & (F.col("type") != "code:file"))
    full = metadata(kg, rows)
    for column, value in (("kind", kind), ("lang", lang)):
        if value:
            full = full.filter(F.col(column) == value)
    return full.orderBy("rank").limit(limit).select("name", "type", "file", "lang", "lines", "signature")


def code_get_symbol(kg: KG, name: str, most: int = 500) -> DataFrame:
    """name, type, callers, callees: the exact symbol, else at most 10 whose name ends in ``::name``."""
    exact = kg.entities.filter((F.col("name") == name) & F.col("type").startswith("code:"))
    if exact.isEmpty():
        exact = kg.entities.filter(F.col("name").endswith(f"::{name}") & F.col("type").startswith("code:")).orderBy("name").limit(10)
    ids = exact.select("id")
    used = kg.relations.filter(F.col("type").isin("calls", "references"))
    ends = lambda key, other: kg.edges(used.join(ids, F.col(key) == F.col("id"), "left_semi"))
    into = ends("to_id", "from").groupBy(F.col("to_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("from")), 1, most).alias("callers"))
    out = ends("from_id", "to").groupBy(F.col("from_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("to")), 1, most).alias("callees"))
    none = F.array().cast("array<string>")
    return exact.join(into, "id", "left").join(out, "id", "left").select("name", "type", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def code_embed(kg: KG, items: DataFrame) -> tuple[KG, DataFrame]:
    """Vectors (pos, name, embedding) of symbols, at most 1,000 in a request and of 768 dimensions."""
    return batch_upsert(kg, items.withColumn("model", F.lit("code")), DIMS)


def code_semantic_search(kg: KG, query: list[float], kind: str | None = None, lang: str | None = None, limit: int = 20) -> DataFrame:
    limit = max(1, min(limit, 500))
    near = nearest(kg, query, clamp_k(5 * limit), "cos")
    rows = kg.entities.filter(F.col("type").startswith("code:")).join(near, F.col("id") == F.col("entity_id")).select("id", "name", "type", "score")
    full = metadata(kg, rows)
    for column, value in (("kind", kind), ("lang", lang)):
        if value:
            full = full.filter(F.col(column) == value)
    return full.orderBy("score", "id").limit(limit).select("name", "type", "file", "lang", "lines", "score")


def purge_files(kg: KG, files: DataFrame) -> KG:
    """``kg`` without files (name) and the symbols they define."""
    from .write import _without

    own = kg.entities.join(files.select("name"), "name", "left_semi").select("id")
    defined = kg.relations.filter(F.col("type") == "defines").join(own, F.col("from_id") == F.col("id"), "left_semi").select(F.col("to_id").alias("id"))
    return _without(kg, own.unionByName(defined).distinct())


def known_files(kg: KG) -> DataFrame:
    """file, hash of the files of an index."""
    files = kg.entities.filter("type = 'code:file'").select("id", F.col("name").alias("file"))
    hashes = kg.observations.filter(F.col("body").startswith("hash: ")).select(F.col("entity_id").alias("id"), F.substring("body", 7, 64).alias("hash"))
    return files.join(hashes, "id").select("file", "hash")


def merged(kg: KG | None, found: DataFrame, links: DataFrame, gone: DataFrame | None = None) -> KG:
    """An index with the symbols and edges of files that were read anew, in place of what it had of them, and without files ``gone`` (file)."""
    new = as_graph(found, links)
    if kg is None:
        return new
    out = found.select(F.col("file").alias("name")).distinct()
    old = purge_files(kg, out if gone is None else out.unionByName(gone.select(F.col("file").alias("name"))))
    return KG(*(getattr(old, t).unionByName(getattr(new, t).select(*getattr(old, t).columns)) for t in ("entities", "observations", "relations", "embeddings")))
