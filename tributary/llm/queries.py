"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import best_record, encodings, exact_spans, format_duplicates, leaks, lookalikes, tokens, truncation
from tributary.plans.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.find_copies(table(spark, sf_dir, "ranked_results"))


@query
def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, sf_dir, "ranked_results"))


@query
def p1_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.unique_rows(table(spark, sf_dir, "ranked_results")).select("query_id", "result_id", "url", "title", "n_copies")


_URL_FORMS = r"""
WITH bare AS (
  SELECT query_id, result_id,
         regexp_replace(regexp_replace(replace(regexp_replace(lower(url), '%(20|0[9a-d]|c2%a0)', ' ', 'g'), '&amp;', '&'),
           '^[^\p{L}\p{N}/]+', ''), '^([a-z][a-z0-9+.-]*:(//+)|/+)', '') AS b
  FROM ranked_results WHERE url <> ''),
cut AS (
  SELECT query_id, result_id, split_part(b, '?', 1) AS path,
         string_split_regex(regexp_replace(b, '^[^?]*\??', ''), '[&;]') AS params FROM bare),
forms AS (
  SELECT query_id, result_id,
         trim(regexp_replace(path, '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) || '?' || array_to_string(list_sort(list_filter(
           list_transform(params, lambda p: trim(regexp_replace(split_part(p, '=', 1), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) || '='
             || trim(regexp_replace(regexp_replace(p, '^[^=]*=?', ''), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))),
           lambda p: p <> '=')), '&') AS form
  FROM cut)
"""

SQL["p1_found"] = _URL_FORMS + """
SELECT first_id, result_id
FROM (SELECT result_id, min(result_id) OVER (PARTITION BY query_id, form) AS first_id FROM forms)
WHERE first_id <> result_id"""

SQL["p1_unique"] = _URL_FORMS + """, n AS (SELECT result_id, min(result_id) OVER w AS first_id, count(*) OVER w AS n_copies FROM forms WINDOW w AS (PARTITION BY query_id, form))
SELECT query_id, result_id, url, title, coalesce(n_copies, 1) AS n_copies FROM ranked_results LEFT JOIN n USING (result_id)
WHERE first_id IS NULL OR first_id = result_id"""

SQL["p1_collapsed"] = _URL_FORMS + """
SELECT query_id, min(result_id) AS first_id, count(*) AS n_copies
FROM forms GROUP BY query_id, form HAVING count(*) > 1"""


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


@query
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, sf_dir, "documents")))


SQL["p6_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.shared_pairs(table(spark, sf_dir, "documents"))


@query
def p8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.members(table(spark, sf_dir, "documents"))


@query
def p8_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.class_pairs(table(spark, sf_dir, "documents"))


@query
def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_spans.shared_share(table(spark, sf_dir, "documents"))


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.find_garbled(table(spark, sf_dir, "ranked_results")).select("result_id", "field")


@query
def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.find_garbled(table(spark, sf_dir, "ranked_results"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.find_unusual(table(spark, sf_dir, "ranked_results")).select("result_id", "field")


@query
def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.find_unusual(table(spark, sf_dir, "ranked_results"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(table(spark, sf_dir, "ranked_results")).select("result_id", "field")


@query
def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(table(spark, sf_dir, "ranked_results"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_record.best_rows(table(spark, sf_dir, "cached_hits"), table(spark, sf_dir, "engines"))


@query
def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_record.best_records(table(spark, sf_dir, "cached_hits"), table(spark, sf_dir, "engines"))


_WINDOWS = """WITH w AS (SELECT doc_id, length(text) AS n, unnest(range(1, length(text) - 198)) AS i, text FROM documents WHERE length(text) >= 200),
s AS (SELECT doc_id, n, i, substr(text, i, 200) AS s FROM w)"""

SQL["p8_found"] = _WINDOWS + """, d AS (SELECT DISTINCT doc_id, s FROM s)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id"""

SQL["p8_members"] = """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n
FROM documents WHERE length(text) >= 200"""

SQL["p8_class_pairs"] = _WINDOWS + """, f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
d AS (SELECT DISTINCT doc_id, s FROM s SEMI JOIN f USING (doc_id))
SELECT DISTINCT a.doc_id AS class_a, b.doc_id AS class_b FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id"""

SQL["p8_share"] = _WINDOWS + """, many AS (SELECT s FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, n, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s SEMI JOIN many USING (s))
SELECT doc_id, CAST(sum(least(200, coalesce(nxt - i, 200))) AS BIGINT) AS shared_chars, sum(least(200, coalesce(nxt - i, 200))) / CAST(any_value(n) AS DOUBLE) AS share
FROM hit GROUP BY doc_id"""
