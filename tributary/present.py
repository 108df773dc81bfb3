"""Text, JSON and compact output, in bulk as columns and for one response as a string."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import score_text, truncate_bytes
from tributary.model import SearchResponse

#: Bytes of a content in text output.
CONTENT_BYTES = 150
_JSON = ("url", "title", "content", "result_type", "engines", "positions", "score", "thumbnail", "published_date")


def json_lines(results: DataFrame) -> DataFrame:
    """``<query>, json``: one object per result."""
    return results.select("query_id", F.to_json(F.struct(*(c for c in _JSON if c in results.columns)), {"ignoreNullFields": "false"}).alias("json"))


def compact_lines(results: DataFrame) -> DataFrame:
    """``query_id, line``: title and url, parted by a tab."""
    return results.select("query_id", F.concat_ws("\t", "title", "url").alias("line"))


def text_blocks(ranked: DataFrame) -> DataFrame:
    """``query_id, rank, block``: number and title, url, shortened content, engines and score."""
    content = F.when(F.col("content") != "", F.concat(F.lit("   "), truncate_bytes(F.col("content"), CONTENT_BYTES), F.lit("\n"))).otherwise("")
    names = F.array_join(F.transform("engines", lambda e: F.concat(F.lit('"'), e, F.lit('"'))), ", ")
    found = F.concat(F.lit("   Engines: {"), names, F.lit("} | Score: "), score_text(F.col("score")))
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n   URL: "), F.col("url"), F.lit("\n"))
    return ranked.select("query_id", "rank", F.concat(head, content, found).alias("block"))


def warnings(errors: DataFrame) -> DataFrame:
    """``query_id, engine, n, warning``: one line per failed source of a query, with its greatest message and how often it failed."""
    per = errors.groupBy("query_id", "engine").agg(F.max("message").alias("message"), F.count("*").alias("n"))
    line = F.concat(F.lit("Warning: "), F.col("engine"), F.lit(" engine failed: "), F.coalesce("message", F.lit("unknown")))
    return per.select("query_id", "engine", "n", line.alias("warning"))


def shorten(text: str, size: int) -> str:
    """Characters that begin within the first ``size`` bytes, then ``...``; short text is kept."""
    data = text.encode()
    if len(data) <= size:
        return text
    return text[: sum((b & 0xC0) != 0x80 for b in data[:size])] + "..."


def render(response: SearchResponse, fmt: str, query: str = "") -> str:
    """A response as ``text``, ``json`` or ``compact``."""
    if fmt == "json":
        return json.dumps([asdict(r) for r in response.results], ensure_ascii=False, indent=2)
    if fmt == "compact":
        return "\n".join(f"{r.title}\t{r.url}" for r in response.results)
    out = ["", f'Search results for "{query}" ({response.count} results in {response.duration_ms}ms):', ""]
    for i, r in enumerate(response.results, 1):
        out += [f"{i}. {r.title}", f"   URL: {r.url}"]
        if r.content:
            out.append(f"   {shorten(r.content, CONTENT_BYTES)}")
        names = ", ".join(f'"{e}"' for e in r.engines)
        out += [f"   Engines: {{{names}}} | Score: {r.score:.2f}", ""]
    return "\n".join(out)
