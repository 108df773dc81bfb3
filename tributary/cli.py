"""Command line: one query over captured pages, the list of sources."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tributary import present
from tributary.api import Federation
from tributary.model import OUTPUT_FORMATS, SearchQuery
from tributary.operators.select import resolve_aliases
from tributary.proxy import Proxy
from tributary.sources import pages as page_source
from tributary.sources.adapters import ADAPTERS, Adapter, request_url


class CapturedSource:
    """A built-in source that reads its page from a table ``request_url, body``."""

    def __init__(self, adapter: Adapter, pages) -> None:
        self.adapter, self.config, self.pages = adapter, adapter.config, pages

    def rank(self, queries):
        from pyspark.sql import functions as F

        asked = queries.select("query_id", F.lit(self.config.name).alias("engine"), request_url(self.adapter, F.col("query")).alias("request_url"))
        got = page_source.captured(asked, self.pages)
        errors = page_source.page_errors(got, {self.config.shortcut: self.adapter}).collect()
        if errors:
            raise RuntimeError(errors[0].message)
        own = {self.config.shortcut: self.adapter}
        rows = page_source.extract_json(got, own) if self.adapter.json else page_source.extract_html(got, own)
        return rows.drop("engine")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tributary", description="Rank fusion over captured result pages.")
    p.add_argument("query", nargs="?", help="what to ask, or 'engines' to list the sources")
    p.add_argument("-e", "--engines", default="ddg,wiki")
    p.add_argument("-l", "--limit", type=int, default=10)
    p.add_argument("-t", "--timeout", type=int, default=10)
    p.add_argument("-f", "--format", choices=OUTPUT_FORMATS, default="text")
    p.add_argument("-p", "--proxy")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--pages", help="Parquet table of captured pages: request_url, body")
    return p


def catalogue() -> str:
    return "\n".join(f"{a.config.shortcut:8} {a.config.name} (weight {a.config.weight:g}, timeout {a.config.timeout}s)" for a in ADAPTERS.values())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.query is None:
        parser().print_help()
        return 0
    if args.query == "engines":
        print(catalogue())
        return 0
    if args.proxy:
        Proxy.parse(args.proxy)
    names = []
    for n in resolve_aliases([n.strip() for n in args.engines.split(",")]):
        if n in ADAPTERS:
            names.append(n)
        else:
            print(f"Warning: unknown engine {n}", file=sys.stderr)
    if not names:
        print("No valid engines specified", file=sys.stderr)
        return 1
    if not args.pages:
        print("No captured pages given (--pages)", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    federation = Federation(spark)
    pages = spark.read.parquet(args.pages)
    for n in names:
        federation.add_engine(CapturedSource(ADAPTERS[n], pages))
    response = federation.ask(SearchQuery(args.query), limit=args.limit)
    for e in response.errors:
        print(f"Warning: {e.engine} engine failed: {e.message}", file=sys.stderr)
    print(present.render(response, args.format, args.query))
    return 0


if __name__ == "__main__":
    sys.exit(main())
