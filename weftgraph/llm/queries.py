"""The queries of this subpackage's operators, and their DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import benchmark_matches
from .fingerprints import compare_neighbours, near_copies
from .jaccard import near_duplicates
from .mixing import mix_sources
from .pii import replace_entities, session_key
from .quality import grades, score_quality
from .suffix_tree import score_documents
from .toxicity import score_toxicity
from .urls import filter_urls
from .warc import archive_folder, read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_warc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(_table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _table(spark, sf_dir, "labels").select("doc_id", grades(F.col("quality"), F.col("toxic")).alias("grade"))
    return score_quality(_table(spark, sf_dir, "documents"), ratings)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(_table(spark, sf_dir, "documents"))


def near_copies_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of op5 over all documents: its classes of near copies."""
    return near_copies(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_toxicity": op3_toxicity,
    "op4_warc_splits": op4_warc_splits,
    "op5_edit_fingerprints": op5_edit_fingerprints,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_jaccard_join": op10_jaccard_join,
    "near_copies_by_fingerprint": near_copies_by_fingerprint,
}
#: A row's digest is told as five-bit pieces of its hash, a component by reaching every smaller id.
ORACLE_SQL: dict[str, str] = {
    "op4_warc_splits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest, row_number() OVER () AS row FROM pages),
     named AS (
  SELECT digest, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(digest, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER), 1), '' ORDER BY k) AS base32
  FROM (SELECT DISTINCT digest FROM p), range(32) t(k) GROUP BY digest),
     placed AS (SELECT p.*, first_value(row) OVER w AS first_row, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST, row))
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, base32 AS payload_digest,
       CASE WHEN row = first_row THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN row <> first_row THEN first_id END AS refers_to
FROM placed JOIN named USING (digest)
""",
    "op10_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     sets AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])) END AS s FROM words),
     kinds AS (SELECT min(doc_id) AS kind, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
     held AS (SELECT kind, n, unnest(s) AS shingle FROM kinds),
     links AS (SELECT a.kind AS a, b.kind AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.kind < b.kind AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
               GROUP BY a.kind, b.kind, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach(node, seen) AS (SELECT kind, kind FROM kinds UNION SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node WHERE r.seen < e.b),
     named AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN kinds k ON k.s = s.s LEFT JOIN named m ON m.node = k.kind
""",
}
