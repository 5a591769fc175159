"""Queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import byte_bpe, cover_tree, fuzzy_lines, licences, mixing, packed_ids, simhash_golay, site_quality, suffix_dedup, webp

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_webp": _over("documents", webp.query),
        "op2_simhash_near_dedup": _over("documents", simhash_golay.query),
        "op3_suffix_dedup": _over("documents", suffix_dedup.query),
        "op4_cover_tree": _over("embeddings", cover_tree.query),
        "op5_site_quality": lambda spark, d: site_quality.query(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")),
        "op6_fuzzy_lines": _over("documents", fuzzy_lines.query),
        "op7_licences": _over("documents", licences.query),
        "op8_mixing": _over("documents", mixing.query),
        "op9_byte_bpe": _over("documents", byte_bpe.query),
        "op10_packed_ids": _over("documents", packed_ids.query),
    }


#: Every 100-byte string by its hash, the later of equal ones, the runs that they cover, and the bytes between.
REPEATS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(b, p + 1, p + 100)) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d)),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM hits)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM runs GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, z FROM (SELECT doc_id, a, z FROM spans UNION ALL SELECT doc_id, octet_length(b), octet_length(b) FROM d)),
kept AS (SELECT doc_id, string_agg(hex(array_slice(b, s + 1, a)), '' ORDER BY a, z) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
#: All pairs of a label, and what is reachable by links.
PAIRS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def oracle_sql() -> dict[str, str]:
    """The others hash with XXH64, fit a model, rake until targets are met, or write files and ids, which SQL does not express."""
    return {"op3_suffix_dedup": REPEATS, "op4_cover_tree": PAIRS}
