"""The subpackage's queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweir.llm import decontaminate, htmltext, langid, media, ngram_join, pieces, pii, quality, repeats, toxicity
from tallyweir.llm.common import table


def piece_model() -> str:
    """The SentencePiece model that the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media_columns, op2_language_id, op3_suffix_array_dedup, op4_ngram_jaccard_join, op5_sentencepiece, op6_pii, op7_benchmark_decontamination, op8_toxicity, op9_quality_classifier, op10_html_extraction)}


#: Near duplicates: shingles as texts, pairs through shared shingles, links, and what they reach.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
several AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT doc_id, g FROM s WHERE g IN (SELECT g FROM several)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

#: Repeats: every string of 100 bytes, ranked by where it starts; a byte goes if a later one of equals covers it.
OP3_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, x, n, unnest(range(n)) AS i FROM h),
w AS (SELECT doc_id, n, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN i + 100 <= n THEN md5_number(substr(x, 2 * i + 1, 200)) END AS s FROM p),
r AS (SELECT doc_id, n, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS later FROM w),
c AS (SELECT doc_id, n, i, byte, max(later::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS begins FROM c),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, sum(begins::INTEGER)::BIGINT AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, h.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN g ON g.doc_id = h.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; tests/llm holds the others against brute force."""
    return {"op3_suffix_array_dedup": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL}
