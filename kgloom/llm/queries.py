"""Queries of the training-data operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .fm_quality import fit_quality, score_quality
from .merkle_range import document_proofs
from .minhash_tensor import near_duplicates
from .mix_flow import mix_sources
from .phrase_parse import phrase_fingerprints
from .prefix_louds import conversation_trie
from .repair_tokens import token_output
from .secret_forest import count_transitions, example_findings, fit_secrets, scan_secrets
from .shared import documents
from .substring_chains import shared_passages
from .surrogates import replace_pii
from .toxicity_chain import fit_chain, score_chain
from .winnow import decontaminate


TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the files are not part of this package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_output(documents(spark, sf_dir), tokenizer_path(TOKENIZER), end_id=0)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(documents(spark, sf_dir), F.array("source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_pii(documents(spark, sf_dir), key=b"kgloom surrogate key for tests and benchmarks")
    return found.select("doc_id", "n_entities", F.concat_ws(",", F.array_sort(F.array_distinct("entities.kind"))).alias("kinds"), "text")


def op5_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(documents(spark, sf_dir))


def op6_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = score_quality(docs, fit_quality(docs, labels, usable=~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Order of the chain: weak labels of kinds of abuse, then the mark that labelled rows carry.
CATEGORIES = ("insult", "shouting", "toxic")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score_chain(docs, fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES))
    return found.select("doc_id", "p_insult", "p_shouting", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan_secrets(docs, fit_secrets(example_findings(), table=count_transitions(docs)))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), k=4, num=80, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_proofs(documents(spark, sf_dir), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprints(documents(spark, sf_dir))


QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_source_mix": op2_source_mix,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_shared_passages": op5_shared_passages,
    "op6_quality_machine": op6_quality_machine,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_secret_forest": op8_secret_forest,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrase_fingerprints": op13_phrase_fingerprints,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in SQL: each byte goes in, then eight shifts (marked -1)."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substring({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return f"sha256(concat({', '.join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values)}))"


_MERKLE_TREE = """
    {t}(g, l, i, n, d) AS (
        SELECT g, 0, i, n, d FROM {base}
        UNION ALL SELECT g, l + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY g, l, i // 8, n
    ),
    {t}_sides AS (
        SELECT g, l, i, coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, l, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
               coalesce(string_agg(d, '' ORDER BY i) OVER (PARTITION BY g, l, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
        FROM {t} WHERE n > 1
    )"""

ORACLE_SQL = {
    "op11_merkle_manifest": f"""
        WITH RECURSIVE
        base AS (
            SELECT doc_id, lang AS lang_, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf('text')} AS d,
                   CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS changed
            FROM documents
        ),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM base),
        {_MERKLE_TREE.format(t='own', base='leaves')},
        subroots AS (SELECT '' AS g, g AS lang_key, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM own WHERE n = 1),
        {_MERKLE_TREE.format(t='top', base='subroots')},
        r AS (SELECT d AS root FROM top WHERE n = 1),
        f(doc_id, leaf, g, l, i, folded, proof) AS (
            SELECT doc_id, d, g, 0, i, coalesce(changed, d), '' FROM leaves
            UNION ALL SELECT f.doc_id, f.leaf, f.g, f.l + 1, f.i // 8, sha256(s.a || f.folded || s.b), f.proof || s.a || s.b FROM f JOIN own_sides s ON s.g = f.g AND s.l = f.l AND s.i = f.i
        ),
        under AS (SELECT f.doc_id, f.leaf, f.folded, f.proof, s.d AS subroot, s.i FROM f JOIN own o ON o.g = f.g AND o.l = f.l AND o.n = 1 JOIN subroots s ON s.lang_key = f.g),
        u(doc_id, leaf, subroot, l, i, folded, proof) AS (
            SELECT doc_id, leaf, subroot, 0, i, folded, proof FROM under
            UNION ALL SELECT u.doc_id, u.leaf, u.subroot, u.l + 1, u.i // 8, sha256(s.a || u.folded || s.b), u.proof || s.a || s.b FROM u JOIN top_sides s ON s.l = u.l AND s.i = u.i
        )
        SELECT u.doc_id, u.leaf, u.subroot, r.root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.root AS verified
        FROM u CROSS JOIN r JOIN top t ON t.l = u.l AND t.n = 1
    """,
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             h AS (SELECT *, CAST({_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS BIGINT) AS h FROM t),
             c AS (SELECT h.conv_id, list_concat(coalesce(t.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20),
             p AS (SELECT conv_id, len(turns) AS m, turns, unnest(range(0, len(turns) + 1)) AS depth FROM c),
             e AS (SELECT conv_id, depth, depth = m AS ending, turns[1:depth] AS k, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN turns[depth].t ELSE '' END AS last FROM p),
             n AS (SELECT depth, k, any_value(up) AS up, min(conv_id) AS least, count(*) AS n, any_value(len(regexp_extract_all(last, '[^\x20\x09-\x0D]+'))) AS words,
                          sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ending), '')) AS ends FROM e GROUP BY depth, k),
             kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS children FROM n WHERE depth > 0 GROUP BY depth, up),
             w AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN kids USING (depth, k)),
             down AS (SELECT w.depth AS d, k, words, n, children, unnest(range(0, w.depth + 1)) AS depth FROM w),
             s AS (SELECT depth, k[1:depth] AS k, sum(CAST(children = 0 AS BIGINT)) AS leaves, sum((n - 1) * words) AS saved FROM down GROUP BY depth, k[1:depth])
        SELECT w.least AS conv_id, w.depth, u.least AS parent_conv_id, w.n AS n_convs, w.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
        FROM w JOIN s USING (depth, k) LEFT JOIN w u ON u.depth = w.depth - 1 AND u.k = w.up
    """,
    "op9_benchmark_leaks": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
             k AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
             iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM k)),
             dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
                    FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n)),
             h AS (SELECT doc_id, item_id, n, p FROM dw JOIN iw USING (n, g)),
             c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
             i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS s FROM documents),
             g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY s)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256
        FROM d JOIN g USING (s)
    """,
}
