"""Captured pages to ranked rows: one data-driven extractor for all HTML sources, JSON without Python.

The extractor gives what stands on a page, box by box; which address a link stands for,
and which rows count, is decided by expressions in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import absolute_link, article_url, redirect_target, result_link, strip_tags
from tributary.sources.adapters import ADAPTERS, Adapter, JsonReader
from tributary.sources.html import first, parse, select

BOXES = "array<struct<href: string, title: string, content: string>>"


def boxes(html: str, adapter: Adapter) -> list[tuple[str, str, str]]:
    """``href, title, content`` of every result box of a page, the link as it stands there."""
    out: list[tuple[str, str, str]] = []
    for box in select(parse(html), adapter.container):
        title = first(box, adapter.title)
        if title is None:
            continue
        link = title if adapter.link is None else first(box, adapter.link)
        if link is None:
            continue
        href = next((link.attrs[a] for a in adapter.attrs if a in link.attrs), "")
        snippet = first(box, adapter.snippet)
        out.append((href, title.text().strip(), "" if snippet is None else snippet.text().strip()))
    return out


def link_target(engine: Column, href: Column, adapters: dict[str, Adapter] = ADAPTERS) -> Column:
    """The address that a link stands for by the rule of its source; null drops the row."""
    target = href
    for a in adapters.values():
        rule = {"redirect": redirect_target, "result": result_link, "absolute": lambda h, a=a: absolute_link(h, a.host)}.get(a.rule)
        if rule is not None:
            target = F.when(engine == a.config.name, rule(href)).otherwise(target)
    return target


def extract_html(pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """``query_id, engine, pos, url, title, content`` from ``query_id, engine, body``.

    Pages of sources without an HTML adapter, null bodies and pages without results give
    no rows. Pages are read where they lie; only the three columns are shipped to Python.
    ``pos`` counts the rows that are kept: those with a url (for some sources one that begins
    with http) and a title.
    """
    by_name = {a.config.name: a for a in adapters.values() if a.json is None}
    src = pages.filter(F.col("engine").isin(list(by_name)) & F.col("body").isNotNull()).select("query_id", "engine", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("href", pa.string()), ("title", pa.string()), ("content", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("href", "title", "content"), b, strict=True)) for b in boxes(body, by_name[e])] for e, body in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["query_id", "engine", "boxes"])

    kind = src.schema["query_id"].dataType.simpleString()
    read = src.mapInArrow(run, f"query_id {kind}, engine string, boxes {BOXES}")
    http_only = [a.config.name for a in by_name.values() if a.http_only]
    rows = F.transform("boxes", lambda b: F.struct(link_target(F.col("engine"), b["href"], adapters).alias("url"), b["title"].alias("title"), b["content"].alias("content")))
    web = lambda r: ~F.col("engine").isin(http_only) | F.startswith(r["url"], F.lit("http"))
    kept = F.filter(rows, lambda r: r["url"].isNotNull() & (r["url"] != "") & (r["title"] != "") & web(r))
    out = read.select("query_id", "engine", F.posexplode(kept).alias("i", "r"))
    return out.select("query_id", "engine", (F.col("i") + 1).alias("pos"), "r.url", "r.title", "r.content")


def register(spark: SparkSession, name: str = "result_boxes") -> None:
    """Makes the extractor a table function of SQL: ``FROM pages, LATERAL result_boxes(body, engine)``.

    It gives ``place, href, title, content`` of every box, the link as it stands on the page.
    """
    by_name = {a.config.name: a for a in ADAPTERS.values() if a.json is None}

    class Boxes:
        def eval(self, body: str, engine: str):
            if body is not None and engine in by_name:
                for n, box in enumerate(boxes(body, by_name[engine]), 1):
                    yield n, *box

    spark.udtf.register(name, F.udtf(Boxes, returnType="place int, href string, title string, content string"))


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is there and of a kind: OBJECT, STRING, BIGINT ..."""
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def decoded(body: Column, reader: JsonReader) -> Column:
    """The list of hits as ``array<variant>``, empty where the outer object is absent; null if the answer is not as it must be."""
    whole = F.try_parse_json(body)
    outer = F.try_variant_get(whole, f"$.{reader.outer}", "variant")
    hits = F.try_variant_get(whole, f"$.{reader.outer}.{reader.hits}", "array<variant>")

    def good(hit: Column) -> Column:
        at = lambda name, kind="variant": F.try_variant_get(hit, f"$.{name}", kind)
        number = F.coalesce(at(reader.number, "decimal(20,0)") >= 0, F.lit(False))
        return _is(hit, "OBJECT") & _is(at(reader.title), "STRING") & _is(at(reader.snippet), "STRING") & (_is(at(reader.number), "BIGINT") | _is(at(reader.number), "DECIMAL(20,0)")) & number

    absent = outer.isNull() | _is(outer, "VOID")
    full = F.when(_is(outer, "OBJECT") & hits.isNotNull() & F.forall(hits, good), hits)
    return F.when(_is(whole, "OBJECT"), F.when(absent, F.array().cast("array<variant>")).otherwise(full))


def extract_json(pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """Rows of the JSON sources, as each adapter says; a body that is no such answer gives none here, and an error row in ``page_errors``."""
    out = None
    for a in adapters.values():
        if a.json is None:
            continue
        text = lambda name: F.try_variant_get("hit", f"$.{name}", "string")
        hits = pages.filter((F.col("engine") == a.config.name) & F.col("body").isNotNull()).select("query_id", "engine", decoded(F.col("body"), a.json).alias("hits"))
        rows = hits.select("query_id", "engine", F.posexplode("hits").alias("i", "hit")).filter(F.col("i") < a.json.limit)
        url = article_url(text(a.json.title), a.json.page)
        rows = rows.select("query_id", "engine", (F.col("i") + 1).alias("pos"), url.alias("url"), text(a.json.title).alias("title"), strip_tags(text(a.json.snippet)).alias("content"))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        out = pages.filter("false").select("query_id", "engine", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("url", "title", "content")))
    return out


def captured(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the ``body`` captured for their url, null where none is, and the seconds it took where ``pages`` has ``latency``.

    Of several captures the latest by ``captured_at`` counts; without that column, or at one time, the greatest body.
    """
    latency = F.col("latency").cast("double") if "latency" in pages.columns else F.lit(None).cast("double")
    at = F.col("captured_at") if "captured_at" in pages.columns else F.lit(0)
    found = pages.select("request_url", F.struct(at.alias("at"), "body", latency.alias("latency")).alias("c")).groupBy("request_url").agg(F.max("c").alias("c"))
    return requests.join(found.select("request_url", "c.body", "c.latency"), "request_url", "left")


def with_status(captured_pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """Captured pages with ``message``: why a page is an error, or null.

    A page is one if it took longer than its source's timeout, is missing, is blocked, or is no
    answer that its source's JSON reader takes.
    """
    late, blocked, unread = F.lit(False), F.lit(False), F.lit(False)
    for a in adapters.values():
        own = F.col("engine") == a.config.name
        if "latency" in captured_pages.columns:
            late = late | (own & (F.col("latency") > a.config.timeout))
        for mark in a.blocked:
            blocked = blocked | (own & F.contains("body", F.lit(mark)))
        if a.json is not None:
            unread = unread | (own & decoded(F.col("body"), a.json).isNull())
    message = (
        F.when(late, F.lit("timed out"))
        .when(F.col("body").isNull(), F.lit("HTTP request failed: no page captured"))
        .when(blocked, F.lit("CAPTCHA or bot check page"))
        .when(unread, F.lit("HTTP request failed: error decoding response body"))
    )
    return captured_pages.withColumn("message", message)


def page_errors(captured_pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """``query_id, engine, message`` of pages that are late, missing, blocked or can't be read."""
    return with_status(captured_pages, adapters).select("query_id", "engine", "message").filter("message is not null")


def readable(captured_pages: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """The pages that ``page_errors`` does not report."""
    return with_status(captured_pages, adapters).filter("message is null").drop("message")
