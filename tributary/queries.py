"""Queries of the core operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import present, proxy
from tributary.functions import text as fx
from tributary.operators import fuse as fusion
from tributary.operators import rank, select
from tributary.plans import answer
from tributary.plans.storage import table
from tributary.sources import adapters, pages, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _flat(fused: DataFrame) -> DataFrame:
    """Arrays as joined strings and rounded scores, for comparison."""
    positions = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return fused.withColumns({"engines": F.array_join("engines", ","), "positions": positions, "score": F.round("score", 6)})


_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace(url, '^(https://)+', ''), '^(http://)+', ''), '/+\z', ''))"

#: One fusion in SQL: ``rows`` has query_id, engine_ord, engine, pos, row, url, title, content,
#: result_type, thumbnail, published_date, weight.
_FUSED = f"""
keyed AS (SELECT *, {_KEY} AS key FROM rows),
per_engine AS (SELECT query_id, key, engine, any_value(weight) AS w FROM keyed GROUP BY ALL),
totals AS (SELECT query_id, key, list_reduce(list(w ORDER BY engine, w), lambda a, x: a * x) * count(*) AS w FROM per_engine GROUP BY ALL),
names AS (SELECT query_id, key, string_agg(engine, ',' ORDER BY engine) AS engines FROM per_engine GROUP BY ALL),
fused AS (
  SELECT query_id, key,
         first(url ORDER BY engine_ord, pos, row) AS url,
         first(title ORDER BY strlen(title) DESC, engine_ord, pos, row) AS title,
         first(content ORDER BY strlen(content) DESC, engine_ord, pos, row) AS content,
         first(result_type ORDER BY engine_ord, pos, row) AS result_type,
         first(thumbnail ORDER BY engine_ord, pos, row) FILTER (thumbnail IS NOT NULL) AS thumbnail,
         first(published_date ORDER BY engine_ord, pos, row) FILTER (published_date IS NOT NULL) AS published_date,
         any_value(engines) AS engines,
         string_agg(CAST(pos AS VARCHAR), ',' ORDER BY engine_ord, pos, row) AS positions,
         round(sum(totals.w / pos), 6) AS score,
         list_reduce(list(totals.w / pos ORDER BY engine_ord, pos, row), lambda a, x: a + x) AS exact,
         round(any_value(totals.w) * count(*), 6) AS high,
         first(engine_ord ORDER BY engine_ord, pos, row) AS first_ord,
         first(pos ORDER BY engine_ord, pos, row) AS first_pos
  FROM keyed JOIN totals USING (query_id, key) JOIN names USING (query_id, key) GROUP BY query_id, key)
"""

_WEIGHTS = "weights AS (SELECT name AS engine, arg_max(weight, engine_ord) AS weight FROM engines GROUP BY name)"
_ALL_ROWS = f"""WITH {_WEIGHTS},
rows AS (SELECT r.*, result_id AS row, coalesce(weight, 1.0) AS weight FROM ranked_results r LEFT JOIN weights USING (engine)),
{_FUSED}"""


def _fused(spark: SparkSession, sf_dir: str, priority: str = "normal") -> DataFrame:
    weights = fusion.weight_table(table(spark, sf_dir, "engines"))
    return fusion.fuse(table(spark, sf_dir, "ranked_results"), weights, priority=priority, row="result_id")


@query
def fuse_ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every query's lists merged, scored and described."""
    return _flat(_fused(spark, sf_dir))


SQL["fuse_ranked_results"] = _ALL_ROWS + "SELECT * EXCLUDE (high, exact) FROM fused"


@query
def fuse_top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each query."""
    out = rank.top_k(_fused(spark, sf_dir), 10)
    return out.select("query_id", "rank", "key", "title", F.round("score", 6).alias("score"))


SQL["fuse_top_10"] = (
    _ALL_ROWS
    + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first_ord, first_pos, key) AS rank FROM fused)
SELECT query_id, CAST(rank AS INTEGER) AS rank, key, title, score FROM ordered WHERE rank <= 10"""
)


@query
def score_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of high priority."""
    return _fused(spark, sf_dir, "high").select("query_id", "key", F.round("score", 6).alias("score"))


SQL["score_high"] = _ALL_ROWS + "SELECT query_id, key, high AS score FROM fused"


@query
def score_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of low priority."""
    return _fused(spark, sf_dir, "low").select("query_id", "key", "score")


SQL["score_low"] = _ALL_ROWS + "SELECT query_id, key, CAST(0 AS DOUBLE) AS score FROM fused"


@query
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores without lists of positions, in two hash aggregations."""
    weights = fusion.weight_table(table(spark, sf_dir, "engines"))
    out = fusion.fused_scores(table(spark, sf_dir, "ranked_results"), weights)
    return out.withColumn("score", F.round("score", 6))


SQL["fused_scores"] = (
    _ALL_ROWS
    + """SELECT query_id, key, count(DISTINCT engine) AS n_engines, count(*) AS n_positions,
round(sum(totals.w / pos), 6) AS score, min(pos) AS best FROM keyed JOIN totals USING (query_id, key) GROUP BY query_id, key"""
)


@query
def limit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after a limit of 10."""
    return rank.limit_counts(_fused(spark, sf_dir), 10)


SQL["limit_counts"] = f"""SELECT query_id, count(DISTINCT {_KEY}) AS count_before, least(count(DISTINCT {_KEY}), 10) AS count_after
FROM ranked_results GROUP BY query_id"""


@query
def weight_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last registration per name counts: the registry followed by a second, halved one."""
    reg = table(spark, sf_dir, "engines").select("engine_ord", "name", "weight")
    again = reg.filter("engine_ord % 2 = 0").select((F.col("engine_ord") + 100).alias("engine_ord"), "name", (F.col("weight") / 2).alias("weight"))
    return fusion.weight_table(reg.unionByName(again))


SQL["weight_registration"] = """SELECT name AS engine, CASE WHEN engine_ord % 2 = 0 THEN weight / 2 ELSE weight END AS weight FROM engines"""

_SELECTED = """selected AS (
  SELECT q.query_id, e.engine_ord, e.name AS engine FROM queries q, engines e
  WHERE e.enabled AND CASE WHEN len(q.engines) > 0 THEN list_contains(q.engines, e.shortcut) ELSE list_has_any(q.categories, e.categories) END)"""


@query
def select_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources each query goes to (J1, P-4, P-5, P-6)."""
    return select.select_engines(table(spark, sf_dir, "queries"), table(spark, sf_dir, "engines"))


SQL["select_engines"] = f"WITH {_SELECTED} SELECT * FROM selected"


def _some_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("query_id") % 7 == 0, F.lit(" 　\t\n")).otherwise(F.col("query"))
    return table(spark, sf_dir, "queries").withColumn("query", blank)


@query
def valid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are not blank; every seventh is made blank (P-8)."""
    return select.valid_queries(_some_blank(spark, sf_dir)).select("query_id", "query")


SQL["valid_queries"] = "SELECT query_id, query FROM queries WHERE query_id % 7 <> 0"


@query
def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are refused, with sources and without any (P-7, P-8, P-9)."""
    asked, known = _some_blank(spark, sf_dir), table(spark, sf_dir, "engines")
    return select.refused(asked, known).unionAll(select.refused(asked, known.filter("weight < 0")))


SQL["refused_queries"] = """SELECT query_id, 'Invalid query: Query cannot be empty' AS message FROM queries WHERE query_id % 7 = 0
UNION ALL SELECT query_id, 'No search engines configured' FROM queries"""


@query
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in the words of each kind of error."""
    kinds = F.array(*map(F.lit, ("HttpError", "ParseError", "SearchTimeout", "NoEngines", "InvalidQuery", "UrlError", "BrowserError")))
    kind = F.element_at(kinds, (F.col("query_id") % 7 + 1).cast("int"))
    errors = table(spark, sf_dir, "engine_errors").select("query_id", "engine", "failed_at", fx.error_text(kind, F.col("message")).alias("text"))
    return errors.groupBy("query_id", "engine", "text").agg(F.count("*").alias("n"))


SQL["error_texts"] = """SELECT query_id, engine, CASE query_id % 7 WHEN 0 THEN 'HTTP request failed: ' || m WHEN 1 THEN 'Failed to parse response: ' || m
  WHEN 2 THEN 'Search timeout exceeded' WHEN 3 THEN 'No search engines configured' WHEN 4 THEN 'Invalid query: ' || m
  WHEN 5 THEN 'URL parsing error: ' || m ELSE 'Browser error: ' || m END AS text, count(*) AS n
FROM (SELECT *, coalesce(message, '') AS m FROM engine_errors) GROUP BY ALL"""


@query
def answer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, select, fuse, limit: delivered rows of the selected sources only."""
    out = answer.answer_table(table(spark, sf_dir, "queries"), table(spark, sf_dir, "engines"), table(spark, sf_dir, "ranked_results"), row="result_id")
    return out.select("query_id", "rank", "key", "url", F.round("score", 6).alias("score"))


SQL["answer_table"] = f"""WITH {_WEIGHTS}, {_SELECTED},
rows AS (SELECT r.*, result_id AS row, weight FROM ranked_results r JOIN weights USING (engine)
         WHERE EXISTS (SELECT 1 FROM selected s WHERE s.query_id = r.query_id AND s.engine = r.engine)),
{_FUSED}, ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first_ord, first_pos, key) AS rank FROM fused)
SELECT query_id, CAST(rank AS INTEGER) AS rank, key, url, score FROM ordered WHERE rank <= 10"""


@query
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed sources of each query beside the results of the others (A15, P-10, S13)."""
    results = table(spark, sf_dir, "ranked_results").groupBy("query_id").agg(F.count("*").alias("n_results"))
    out = present.warnings(table(spark, sf_dir, "engine_errors")).join(results, "query_id", "left")
    return out.select("query_id", "engine", "n", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "warning")


SQL["error_report"] = """WITH r AS (SELECT query_id, count(*) AS n_results FROM ranked_results GROUP BY query_id)
SELECT e.query_id, e.engine, count(*) AS n, coalesce(any_value(r.n_results), 0) AS n_results,
       'Warning: ' || e.engine || ' engine failed: ' || coalesce(max(message), 'unknown') AS warning
FROM engine_errors e LEFT JOIN r USING (query_id) GROUP BY e.query_id, e.engine"""


@query
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all urls (F1)."""
    return table(spark, sf_dir, "ranked_results").select("result_id", fx.normalized_url(F.col("url")).alias("key"))


SQL["normalize_url"] = f"SELECT result_id, {_KEY} AS key FROM ranked_results"


@query
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request of every query to every built-in source."""
    return adapters.requests(table(spark, sf_dir, "queries")).select("query_id", "engine", "request_url")


SQL["request_urls"] = """WITH t(engine, a, b) AS (VALUES
  ('DuckDuckGo', 'https://html.duckduckgo.com/html/?q=', ''),
  ('Brave', 'https://search.brave.com/search?q=', ''),
  ('Wikipedia', 'https://en.wikipedia.org/w/api.php?action=query&list=search&srsearch=', '&format=json&srlimit=10'),
  ('Sogou', 'https://www.sogou.com/web?query=', ''),
  ('360 Search', 'https://www.so.com/s?q=', ''),
  ('Google', 'https://www.google.com/search?q=', '&hl=en'),
  ('Baidu', 'https://www.baidu.com/s?wd=', ''),
  ('Bing China', 'https://cn.bing.com/search?q=', '')
) SELECT query_id, engine, a || url_encode(query) || b AS request_url FROM queries, t"""


@query
def redirect_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of redirect links made of all urls."""
    link = F.concat(F.lit("//duckduckgo.com/l/?uddg="), fx.url_encode(F.col("url")), F.lit("&from=list"))
    return table(spark, sf_dir, "ranked_results").select("result_id", fx.redirect_target(link).alias("target"))


SQL["redirect_decode"] = "SELECT result_id, split_part(url, '&', 1) AS target FROM ranked_results"


@query
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links kept, unwrapped, completed or dropped."""
    kind = F.col("result_id") % 4
    href = (
        F.when(kind == 0, F.concat(F.lit("/url?q="), "url", F.lit("&sa=U")))
        .when(kind == 1, F.concat(F.lit("/search?q="), "url"))
        .when(kind == 2, F.concat(F.lit("/url?x="), "url"))
        .otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "ranked_results").withColumn("href", href)
    return rows.select(
        "result_id",
        fx.result_link(F.col("href")).alias("result"),
        fx.absolute_link(F.col("href"), "https://www.sogou.com").alias("absolute"),
        fx.preferred_link(F.col("thumbnail"), F.col("href")).alias("preferred"),
        fx.article_url(F.col("title"), "https://en.wikipedia.org/wiki/{title}").alias("article"),
    )


SQL["link_rules"] = """WITH h AS (SELECT *, CASE result_id % 4 WHEN 0 THEN '/url?q=' || url || '&sa=U' WHEN 1 THEN '/search?q=' || url
  WHEN 2 THEN '/url?x=' || url ELSE url END AS href FROM ranked_results)
SELECT result_id,
  CASE WHEN starts_with(href, '/url?q=') THEN split_part(substr(href, 8), '&', 1)
       WHEN starts_with(href, '/') AND NOT starts_with(href, '/url?') THEN NULL ELSE href END AS result,
  CASE WHEN starts_with(href, '/') THEN 'https://www.sogou.com' || href ELSE href END AS absolute,
  coalesce(thumbnail, href, '') AS preferred,
  'https://en.wikipedia.org/wiki/' || replace(title, ' ', '_') AS article FROM h"""


@query
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text without tags (F2)."""
    html = F.concat(F.lit("<p class='a'><b>"), "title", F.lit("</b> > "), "content", F.lit("<br"))
    return table(spark, sf_dir, "ranked_results").select("result_id", fx.strip_tags(html).alias("plain"))


SQL["strip_tags"] = """SELECT result_id, regexp_replace('<p class=''a''><b>' || title || '</b> > ' || content || '<br', '<[^>]*>?|>', '', 'g') AS plain
FROM ranked_results"""


@query
def truncate_150(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts shortened to 150 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", fx.truncate_bytes(F.col("text"), 150).alias("short"), F.octet_length("text").alias("bytes"))


SQL["truncate_150"] = """SELECT doc_id, CASE WHEN strlen(text) <= 150 THEN text ELSE
  left(text, CAST(list_max(list_filter(range(1, 151), lambda i: strlen(left(text, i - 1)) < 150)) AS BIGINT)) || '...' END AS short,
  CAST(strlen(text) AS INTEGER) AS bytes FROM documents"""


@query
def fuse_events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sources, a query per day, the 50 highest values each."""
    events = table(spark, sf_dir, "events")
    ranked = tables.ranked_table(events, query=[F.date_trunc("day", "ts")], engine=F.col("event_type"), order=[F.desc("value"), F.asc("event_id")], limit=50)
    rows = ranked.withColumn("url", F.col("user_id").cast("string"))
    out = fusion.fused_scores(rows)
    day = F.date_format("query_id", "yyyy-MM-dd")
    return out.select(day.alias("day"), F.col("key").cast("long").alias("user_id"), "n_engines", F.round("score", 6).alias("score"), "best")


SQL["fuse_events_daily"] = """WITH r AS (SELECT event_type engine, date_trunc('day', ts) qid, user_id,
    row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY value DESC, event_id) pos FROM events),
rr AS (SELECT * FROM r WHERE pos <= 50),
pe AS (SELECT qid, user_id, count(DISTINCT engine) n FROM rr GROUP BY qid, user_id)
SELECT strftime(rr.qid, '%Y-%m-%d') AS day, rr.user_id, max(pe.n) AS n_engines, round(sum(pe.n / CAST(pos AS DOUBLE)), 6) AS score, CAST(min(pos) AS INTEGER) AS best
FROM rr JOIN pe ON rr.qid = pe.qid AND rr.user_id = pe.user_id GROUP BY rr.qid, rr.user_id"""


@query
def fuse_parts_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag and status as sources, parts ranked by price, all positions."""
    lines = table(spark, sf_dir, "lineitem").filter("l_partkey is not null")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    ranked = tables.ranked_table(lines, query=[F.year("l_shipdate")], engine=F.concat("l_returnflag", "l_linestatus"), order=order)
    weights = spark.createDataFrame([("AF", 1.5), ("RF", 0.5)], "engine string, weight double")
    out = fusion.fused_scores(ranked.withColumn("url", F.col("l_partkey").cast("string")), weights)
    return out.select(F.col("query_id").alias("year"), F.col("key").cast("long").alias("part"), "n_engines", "n_positions", F.round("score", 6).alias("score"))


SQL["fuse_parts_by_flag"] = """WITH r AS (SELECT l_returnflag || l_linestatus engine, CAST(year(l_shipdate) AS INTEGER) qid, l_partkey part,
    row_number() OVER (PARTITION BY l_returnflag || l_linestatus, year(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) pos FROM lineitem),
pe AS (SELECT qid, part, engine, CASE engine WHEN 'AF' THEN 1.5 WHEN 'RF' THEN 0.5 ELSE 1.0 END w FROM r GROUP BY ALL),
t AS (SELECT qid, part, product(w) * count(*) w, count(*) n FROM pe GROUP BY ALL)
SELECT r.qid AS year, r.part, any_value(t.n) AS n_engines, count(*) AS n_positions, round(sum(t.w / pos), 6) AS score
FROM r JOIN t ON r.qid = t.qid AND r.part = t.part GROUP BY r.qid, r.part"""


@query
def fuse_documents_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engines rank documents by length; one page per source host and kind (A3, A4 on multi-byte text)."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    ranked = tables.ranked_table(docs, query=[F.col("kind")], engine=F.col("engine"), order=[F.desc("n_chars"), F.asc("doc_id")])
    rows = ranked.select("query_id", "engine", F.lit(0).alias("engine_ord"), "pos", "doc_id", F.col("source").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    out = fusion.fuse(rows, row="doc_id")
    return out.select("query_id", "key", "title", F.md5("content").alias("content"), F.array_join("engines", ",").alias("engines"), F.size("positions").alias("n"), F.round("score", 6).alias("score"))


SQL["fuse_documents_by_kind"] = f"""WITH ranked AS (SELECT kind AS query_id, engine, 0 AS engine_ord, doc_id AS row, source AS url,
    split_part(text, chr(10), 1) AS title, text AS content, 'web' AS result_type, NULL AS thumbnail, NULL AS published_date, 1.0 AS weight,
    row_number() OVER (PARTITION BY kind, engine ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE text IS NOT NULL),
rows AS (SELECT * FROM ranked), {_FUSED}
SELECT query_id, key, title, md5(content) AS content, engines, CAST(len(string_split(positions, ',')) AS INTEGER) AS n, score FROM fused"""


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of different tables as one bag of rows."""
    live = table(spark, sf_dir, "ranked_results").select("engine", "url", "title", F.col("pos").cast("int").alias("pos"))
    kept = table(spark, sf_dir, "cached_hits").select(F.explode("engines").alias("engine"), "url", "title")
    both = live.unionByName(kept, allowMissingColumns=True)
    return both.groupBy("engine").agg(F.count("*").alias("n"), F.count("pos").alias("n_ranked"), F.count_distinct(fx.normalized_url(F.col("url"))).alias("n_keys"))


SQL["union_sources"] = f"""WITH u AS (SELECT engine, url, pos FROM ranked_results UNION ALL SELECT unnest(engines), url, NULL FROM cached_hits)
SELECT engine, count(*) AS n, count(pos) AS n_ranked, count(DISTINCT {_KEY}) AS n_keys FROM u GROUP BY engine"""


def _escaped(c: str) -> Column:
    e = F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(F.replace(e, F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


#: How each built-in source's page shows a result; {u}, {t} and {c} are url, title and content.
_SHAPES = {
    "DuckDuckGo": '<div class="result x"><h2 class="result__title"><a href="{u}">{t}</a></h2><a class="result__snippet">{c}</a></div>',
    "Brave": '<div class="snippet" data-type="web"><a href="{u}"><span class="search-snippet-title">{t}</span></a><p class="snippet-description">{c}</p></div>',
    "Sogou": '<div class="vrwrap"><h3 class="vr-title"><a href="{u}">{t}</a></h3><div class="space-txt">{c}</div></div>',
    "360 Search": '<ul><li class="res-list"><h3><a href="/away" data-mdurl="{u}">{t}</a></h3><p class="res-desc">{c}</p></li></ul>',
    "Google": '<div class="g"><a href="/url?q={u}&amp;sa=U"><h3>{t}</h3></a><div class="VwiC3b">{c}</div></div>',
    "Baidu": '<div class="c-container"><h3><a href="{u}">{t}</a></h3><span class="c-abstract">{c}</span></div>',
    "Bing China": '<ol><li class="b_algo"><h2><a href="{u}">{t}</a></h2><div class="b_caption"><p>{c}</p></div></li></ol>',
}
_HTML_NAMES = list(_SHAPES)


def _captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages made of the delivered rows: one per query and engine, shaped like a built-in source's."""
    rows = table(spark, sf_dir, "ranked_results").withColumn("shape", F.element_at(F.array(*map(F.lit, _HTML_NAMES)), (F.col("engine_ord") % 7 + 1).cast("int")))
    html = F.lit("")
    for name, shape in _SHAPES.items():
        filled = F.lit(shape)
        for mark, c in (("{u}", "url"), ("{t}", "title"), ("{c}", "content")):
            filled = F.replace(filled, F.lit(mark), _escaped(c))
        html = F.when(F.col("shape") == name, filled).otherwise(html)
    # pages are split, as a source's pages are, so that none grows with the number of rows
    pages_ = rows.withColumn("page", F.floor(F.col("result_id") / 500)).groupBy("query_id", "engine", "shape", "page")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("result_id", html.alias("h")))), lambda s: s["h"]), "\n")
    return pages_.agg(F.concat(F.lit("<!doctype html><html><body>"), body, F.lit("</body></html>")).alias("body"))


@query
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back from result pages in the shapes of the seven HTML sources (X1-X7, F10, P-1, P-2, W1)."""
    made = _captured_pages(spark, sf_dir).select(F.concat_ws("|", "query_id", "engine", "page").alias("query_id"), F.col("shape").alias("engine"), "body")
    return pages.extract_html(made)


_TRIM = r"regexp_replace(regexp_replace({}, '^[\s\x{{85}}\x{{a0}}\x{{1c}}-\x{{1f}}\p{{Z}}]+', ''), '[\s\x{{85}}\x{{a0}}\x{{1c}}-\x{{1f}}\p{{Z}}]+$', '')"
SQL["extract_pages"] = f"""WITH named AS (SELECT *, ['{"', '".join(_HTML_NAMES)}'][engine_ord % 7 + 1] AS shape,
    CAST(query_id AS VARCHAR) || '|' || engine || '|' || CAST(result_id // 500 AS VARCHAR) AS page, {_TRIM.format('title')} AS t, {_TRIM.format('content')} AS c FROM ranked_results),
links AS (SELECT *, CASE shape WHEN 'Sogou' THEN CASE WHEN starts_with(url, '/') THEN 'https://www.sogou.com' || url ELSE url END
    WHEN 'Google' THEN split_part(url, '&', 1) ELSE url END AS link FROM named),
kept AS (SELECT * FROM links WHERE link <> '' AND t <> '' AND (shape NOT IN ('Brave', 'Bing China') OR starts_with(link, 'http')))
SELECT page AS query_id, shape AS engine, CAST(row_number() OVER (PARTITION BY page ORDER BY result_id) AS INTEGER) AS pos, link AS url, t AS title, c AS content FROM kept"""


_WIKIS = ("Wikipedia", "Vikipedi")


def _two_wikis() -> dict[str, adapters.Adapter]:
    """The encyclopedia twice: as it is built in, and under another name in another language."""
    wiki = adapters.ADAPTERS["wiki"]
    return {"wiki": wiki, "tr": adapters.override(adapters.with_language(wiki, "tr"), name=_WIKIS[1], shortcut="tr")}


@query
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON answers of two encyclopedias, made of each query's rows and read back."""
    rows = table(spark, sf_dir, "ranked_results").withColumn("page", F.floor(F.col("result_id") / 500))
    hit = F.struct(F.col("title"), F.concat(F.lit("<b>"), "title", F.lit("</b> "), F.col("url")).alias("snippet"), F.col("result_id").alias("pageid"))
    hits = F.transform(F.array_sort(F.collect_list(F.struct("result_id", hit.alias("hit")))), lambda s: s["hit"])
    made = rows.groupBy("query_id", "page").agg(F.to_json(F.struct(F.struct(hits.alias("search")).alias("query"))).alias("body"))
    made = made.select(F.concat_ws("|", "query_id", "page").alias("query_id"), "body", F.element_at(F.array(*map(F.lit, _WIKIS)), (F.col("query_id") % 2 + 1).cast("int")).alias("engine"))
    return pages.extract_json(made, _two_wikis()).select("query_id", "engine", "pos", "url", "title", "content")


SQL["json_source"] = """WITH n AS (SELECT *, CAST(query_id AS VARCHAR) || '|' || CAST(result_id // 500 AS VARCHAR) AS page,
    row_number() OVER (PARTITION BY query_id, result_id // 500 ORDER BY result_id) AS n FROM ranked_results)
SELECT page AS query_id, CASE query_id % 2 WHEN 0 THEN 'Wikipedia' ELSE 'Vikipedi' END AS engine, CAST(n AS INTEGER) AS pos,
  'https://' || CASE query_id % 2 WHEN 0 THEN 'en' ELSE 'tr' END || '.wikipedia.org/wiki/' || replace(title, ' ', '_') AS url, title,
  regexp_replace('<b>' || title || '</b> ' || url, '<[^>]*>?|>', '', 'g') AS content FROM n WHERE n <= 10"""


#: Answers of the JSON source by the last digit of the query, and whether they can be read.
_ANSWERS = (
    ('{"query":{"search":[{"title":"T","snippet":"<i>s</i>","pageid":1,"ns":0}]},"batchcomplete":""}', True),
    ('{"query":{"search":[]}}', True),
    ('{"batchcomplete":""}', True),
    ('{"query":null}', True),
    ('{"query":5}', False),
    ('{"query":{}}', False),
    ("[]", False),
    ('{"query":{"search":[{"title":"T","snippet":"s","pageid":1},{"snippet":"s","pageid":2}]}}', False),
    ('{"query":{"search":[{"title":"T","pageid":1}]}}', False),
    ('{"query":{"search":[{"title":7,"snippet":"s","pageid":-1}]}}', False),
)


@query
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that can't be read are errors and give no rows (X8, P-10, A15)."""
    body = F.element_at(F.array(*(F.lit(a) for a, _ in _ANSWERS)), (F.col("query_id") % 10 + 1).cast("int"))
    got = table(spark, sf_dir, "queries").select("query_id", F.lit("Wikipedia").alias("engine"), body.alias("body"))
    rows = pages.extract_json(got).groupBy("query_id").agg(F.count("*").alias("n"))
    out = pages.with_status(got).join(rows, "query_id", "left")
    fine = pages.readable(got).select("query_id", F.lit(True).alias("readable"))
    out = out.join(fine, "query_id", "left")
    return out.select("query_id", "message", F.coalesce("readable", F.lit(False)).alias("readable"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


SQL["json_errors"] = """SELECT query_id, CASE WHEN query_id % 10 >= 4 THEN 'HTTP request failed: error decoding response body' END AS message,
  query_id % 10 < 4 AS readable, CASE WHEN query_id % 10 = 0 THEN 1 ELSE 0 END::BIGINT AS n FROM queries"""


@query
def deadline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that took longer than their own timeout (A15, P-10)."""
    sent = adapters.requests(table(spark, sf_dir, "queries"))
    took = sent.withColumns({"body": F.when(F.col("query_id") % 4 > 0, F.lit("<html></html>")), "latency": (F.col("query_id") % 12).cast("double")}).filter("engine <> 'Wikipedia'")
    return pages.page_errors(took).groupBy("engine", "message").agg(F.count("*").alias("n"))


SQL["deadline_errors"] = """WITH t(engine, deadline) AS (VALUES ('DuckDuckGo', 5), ('Brave', 5), ('Sogou', 5), ('360 Search', 5), ('Google', 10), ('Baidu', 10), ('Bing China', 10))
SELECT engine, CASE WHEN query_id % 12 > deadline THEN 'timed out' ELSE 'HTTP request failed: no page captured' END AS message, count(*) AS n
FROM queries, t WHERE query_id % 12 > deadline OR query_id % 4 = 0 GROUP BY ALL"""


def _pages_by_request(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All requests, and captured bodies for most of them; some blocked, some broken."""
    sent = adapters.requests(table(spark, sf_dir, "queries"))
    n = F.col("query_id") % 5
    body = (
        F.when((n == 1) & (F.col("engine") == "Google"), F.lit('<form action="/sorry/index"></form>'))
        .when((n == 2) & (F.col("engine") == "Wikipedia"), F.lit("<html>busy"))
        .when(F.col("engine") == "Wikipedia", F.lit('{"query":{"search":[]}}'))
        .otherwise(F.lit("<html><body></body></html>"))
    )
    return sent, sent.filter(n != 0).select("request_url", body.alias("body"))


@query
def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests met with captured pages; missing, blocked and broken ones become errors (J4, S2, S3, P-3, P-10)."""
    sent, kept = _pages_by_request(spark, sf_dir)
    got = pages.captured(sent, kept)
    errors = pages.page_errors(got).groupBy("engine", "message").agg(F.count("*").alias("n"))
    fine = pages.readable(got).groupBy("engine").agg(F.count("*").alias("n")).withColumn("message", F.lit("readable"))
    return errors.unionByName(fine)


_REQUESTS = SQL["request_urls"].removeprefix("WITH ")
SQL["captured_pages"] = f"""WITH {_REQUESTS.split(") SELECT")[0]}), sent AS (SELECT{_REQUESTS.split(") SELECT")[1]}),
pages AS (SELECT request_url, any_value(CASE WHEN query_id % 5 = 1 AND engine = 'Google' THEN 'blocked' WHEN query_id % 5 = 2 AND engine = 'Wikipedia' THEN 'broken' ELSE 'fine' END) AS body
  FROM sent WHERE query_id % 5 <> 0 GROUP BY request_url),
got AS (SELECT sent.engine, body FROM sent LEFT JOIN pages USING (request_url))
SELECT engine, CASE WHEN body IS NULL THEN 'HTTP request failed: no page captured' WHEN body = 'blocked' THEN 'CAPTCHA or bot check page'
  ELSE 'HTTP request failed: error decoding response body' END AS message, count(*) AS n FROM got WHERE body IS NULL OR body <> 'fine' GROUP BY ALL
UNION ALL SELECT engine, 'readable', count(*) FROM got WHERE body = 'fine' GROUP BY engine"""


@query
def round_robin_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proxies handed out in turn, in the order of requests, which keep all they carry."""
    pool = proxy.ProxyPool([proxy.Proxy.parse(u) for u in ("http://a.test", "https://u:p@b.test", "socks5://c.test:9")])
    return proxy.assign_round_robin(table(spark, sf_dir, "ranked_results").select("result_id", "query_id", "url", "title", "content"), pool, key="result_id")


SQL["round_robin_proxy"] = """SELECT result_id, query_id, url, title, content, ['http://a.test:8080', 'https://u:p@b.test:443', 'socks5://c.test:9'][(row_number() OVER (ORDER BY result_id) - 1) % 3 + 1] AS proxy
FROM ranked_results"""


@query
def proxy_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a table of proxies, with and without credentials, one added twice and one removed."""
    e = table(spark, sf_dir, "engines")
    made = e.select(
        F.lower("name").alias("host"), (F.col("engine_ord") + 8080).alias("port"), F.element_at(F.array(F.lit("http"), F.lit("https"), F.lit("socks5")), (F.col("engine_ord") % 3 + 1).cast("int")).alias("protocol"),
        F.when(F.col("engine_ord") % 2 == 0, F.col("shortcut")).alias("username"), F.when(F.col("engine_ord") % 4 == 0, F.lit("pw")).alias("password"),
    )
    more = spark.createDataFrame([("added.test", 99, "http", None, None)] * 2, made.schema)
    gone = made.filter("port % 5 = 1").select("host", "port")
    return proxy.rendered(proxy.without(made.unionByName(more), gone)).select("host", "proxy_url")


SQL["proxy_urls"] = """SELECT lower(name) AS host, ['http', 'https', 'socks5'][engine_ord % 3 + 1] || '://' || CASE WHEN engine_ord % 4 = 0 THEN shortcut || ':pw@' ELSE '' END
  || lower(name) || ':' || CAST(engine_ord + 8080 AS VARCHAR) AS proxy_url FROM engines WHERE (engine_ord + 8080) % 5 <> 1
UNION ALL SELECT 'added.test', 'http://added.test:99' FROM range(2)"""


@query
def compact_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per fused result."""
    return present.compact_lines(_fused(spark, sf_dir))


SQL["compact_output"] = _ALL_ROWS + "SELECT query_id, title || chr(9) || url AS line FROM fused"


@query
def text_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered blocks of the ten best of each query."""
    return present.text_blocks(rank.top_k(_fused(spark, sf_dir), 10))


_SHORT = """CASE WHEN strlen({0}) <= 150 THEN {0} ELSE
  left({0}, CAST(list_max(list_filter(range(1, 151), lambda i: strlen(left({0}, i - 1)) < 150)) AS BIGINT)) || '...' END"""
_TOP = ", ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, first_ord, first_pos, key) AS rank FROM fused)\n"
SQL["text_output"] = _ALL_ROWS + _TOP + f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(rank AS VARCHAR) || '. ' || title || chr(10) || '   URL: ' || url || chr(10)
  || CASE WHEN content <> '' THEN '   ' || {_SHORT.format('content')} || chr(10) ELSE '' END
  || '   Engines: {{"' || replace(engines, ',', '", "') || '"}} | Score: ' || printf('%.2f', exact) AS block FROM ordered WHERE rank <= 10"""


@query
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per fused result."""
    return present.json_lines(_fused(spark, sf_dir).withColumn("score", F.round("score", 6)))


SQL["json_output"] = _ALL_ROWS + """SELECT query_id, to_json({'url': url, 'title': title, 'content': content, 'result_type': result_type, 'engines': string_split(engines, ','),
  'positions': list_transform(string_split(positions, ','), lambda p: CAST(p AS INTEGER)), 'score': score, 'thumbnail': thumbnail, 'published_date': published_date}) AS json FROM fused"""


@query
def fuse_seeded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that already carry engines and positions: those of a page's first row count."""
    hits = table(spark, sf_dir, "cached_hits").filter("size(engines) > 0").withColumns({"seed_engines": F.col("engines"), "seed_positions": F.array(F.lit(4))})
    ranked = tables.ranked_table(hits, query=[F.col("result_type")], engine=F.element_at("engines", 1), order=[F.desc("score"), F.asc("hit_id")])
    out = _flat(fusion.fuse(ranked.withColumn("engine_ord", F.lit(0)), fusion.weight_table(table(spark, sf_dir, "engines")), row="hit_id"))
    return out.select(F.col("query_id").alias("result_type"), "key", "engines", "positions", "score")


SQL["fuse_seeded_hits"] = f"""WITH {_WEIGHTS},
r AS (SELECT result_type, {_KEY} AS key, engines, engines[1] AS engine, hit_id,
    row_number() OVER (PARTITION BY result_type, engines[1] ORDER BY score DESC, hit_id) AS pos FROM cached_hits WHERE len(engines) > 0),
g AS (SELECT result_type, key, list(engine) AS own, first(engines ORDER BY pos, hit_id) AS seeds, list(pos ORDER BY pos, hit_id) AS places FROM r GROUP BY ALL),
names AS (SELECT result_type, key, unnest(list_distinct(list_concat(own, seeds))) AS engine FROM g),
w AS (SELECT result_type, key, list_reduce(list(coalesce(weight, 1.0) ORDER BY engine), lambda a, x: a * x) * count(*) AS w, string_agg(engine, ',' ORDER BY engine) AS engines
  FROM names LEFT JOIN weights USING (engine) GROUP BY ALL)
SELECT result_type, key, w.engines, '4,' || array_to_string(places, ',') AS positions,
  round(list_sum(list_transform(list_prepend(4, places), lambda p: w.w / p)), 6) AS score FROM g JOIN w USING (result_type, key)"""


@query
def builtin_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of built-in sources, with overrides."""
    changed = {**adapters.ADAPTERS, "brave": adapters.override(adapters.ADAPTERS["brave"], weight=2.0, enabled=False)}
    return adapters.registry(spark, changed).select("engine_ord", "name", "shortcut", "weight", "timeout", "enabled", "paging", "safesearch")


SQL["builtin_registry"] = """SELECT CAST(o AS INTEGER) AS engine_ord, name, shortcut, CAST(w AS DOUBLE) AS weight, CAST(t AS BIGINT) AS timeout, e AS enabled, p AS paging, s AS safesearch
FROM (VALUES (0, 'DuckDuckGo', 'ddg', 1.0, 5, true, true, true), (1, 'Brave', 'brave', 2.0, 5, false, true, true),
  (2, 'Wikipedia', 'wiki', 1.2, 5, true, false, false), (3, 'Sogou', 'sogou', 1.0, 5, true, true, false),
  (4, '360 Search', '360', 1.0, 5, true, true, false), (5, 'Google', 'g', 1.5, 10, true, true, true),
  (6, 'Baidu', 'baidu', 1.0, 10, true, true, false), (7, 'Bing China', 'bing_cn', 1.0, 10, true, true, true)) t(o, name, shortcut, w, t, e, p, s)"""


@query
def first_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that a source's order gives, from 1."""
    rows = table(spark, sf_dir, "cached_hits").withColumn("engine", F.explode(F.array_distinct("engines")))
    out = tables.ranked_table(rows, query=[F.col("result_type")], engine=F.col("engine"), order=[F.desc("score"), F.asc("hit_id")])
    return out.select(F.col("query_id").alias("result_type"), "engine", "pos", "hit_id")


SQL["first_lists"] = """SELECT result_type, engine, hit_id,
  CAST(row_number() OVER (PARTITION BY result_type, engine ORDER BY score DESC, hit_id) AS INTEGER) AS pos
FROM (SELECT *, unnest(engines) AS engine FROM (SELECT result_type, list_distinct(engines) AS engines, score, hit_id FROM cached_hits))"""
