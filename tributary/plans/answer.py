"""End to end: queries to requests, captured pages to rows, rows to fused results and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.fuse import fuse, weight_table
from tributary.operators.rank import top_k
from tributary.operators.select import select_engines, valid_queries
from tributary.sources import pages as page_source
from tributary.sources.adapters import ADAPTERS, Adapter, registry, requests


def answer_captured(queries: DataFrame, pages: DataFrame, *, adapters: dict[str, Adapter] = ADAPTERS, limit: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """Fused results and errors of many queries over a table of captured pages.

    ``queries`` has ``query_id, query, categories, engines``; ``pages`` has ``request_url,
    body`` and optionally ``captured_at`` and ``latency`` (seconds). Sources are selected before any page is joined. A failed page is an error row
    and costs no result of the others.
    """
    spark = queries.sparkSession
    known = registry(spark, adapters)
    asked = valid_queries(queries)
    wanted = select_engines(asked, known)
    sent = requests(asked, adapters).join(wanted.select("query_id", "engine"), ["query_id", "engine"], "left_semi")
    got = page_source.captured(sent, pages)
    good = page_source.readable(got, adapters)
    rows = page_source.extract_html(good, adapters)
    if any(a.json for a in adapters.values()):
        rows = rows.unionByName(page_source.extract_json(good, adapters))
    ords = known.select(F.col("name").alias("engine"), "engine_ord")
    fused = fuse(rows.join(F.broadcast(ords), "engine"), weight_table(known))
    return top_k(fused, limit), page_source.page_errors(got, adapters)


def answer_table(queries: DataFrame, registry_table: DataFrame, ranked: DataFrame, *, limit: int | None = 10, row: str | None = None) -> DataFrame:
    """Fused results of many queries over ranked rows that sources already delivered."""
    wanted = select_engines(valid_queries(queries), registry_table).select("query_id", "engine")
    mine = ranked.join(wanted, ["query_id", "engine"], "left_semi")
    return top_k(fuse(mine, weight_table(registry_table), row=row), limit)
