"""Source adapters as data: how to ask a source and how to read its page."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import url_encode
from tributary.model import REGISTRY, EngineConfig


@dataclass(frozen=True)
class JsonReader:
    """How to read a JSON answer: an object ``outer`` (absent: no results) with a list ``hits`` of objects that
    have the strings ``title`` and ``snippet`` and the whole number ``number``. ``page`` is the address of a
    title, in which blanks become underscores.
    """

    outer: str
    hits: str
    title: str
    snippet: str
    number: str
    page: str
    limit: int = 10


@dataclass(frozen=True)
class Adapter:
    """A source. ``link`` says where the url is: the title element, or the first fit of a selector."""

    config: EngineConfig
    request: str  # the encoded query goes where {q} stands
    container: str = ""
    title: str = ""
    snippet: str = ""
    link: str | None = None
    attrs: tuple[str, ...] = ("href",)
    rule: str = "plain"  # plain, redirect, result or absolute
    host: str = ""
    http_only: bool = False
    blocked: tuple[str, ...] = ()
    json: JsonReader | None = None


def _config(name: str, shortcut: str, weight: float, timeout: int, paging: bool, safesearch: bool) -> EngineConfig:
    return EngineConfig(name, shortcut, ["general"], weight, timeout, True, paging, safesearch)


#: Request templates, selectors and settings of the built-in sources.
ADAPTERS: dict[str, Adapter] = {
    a.config.shortcut: a
    for a in (
        Adapter(
            _config("DuckDuckGo", "ddg", 1.0, 5, True, True), "https://html.duckduckgo.com/html/?q={q}", ".result", ".result__title a", ".result__snippet", rule="redirect"
        ),
        Adapter(
            _config("Brave", "brave", 1.0, 5, True, True), "https://search.brave.com/search?q={q}", 'div.snippet[data-type="web"]', ".search-snippet-title",
            ".generic-snippet .content, .snippet-description", link='a[href^="http"]', http_only=True,
        ),
        Adapter(
            _config("Wikipedia", "wiki", 1.2, 5, False, False), "https://en.wikipedia.org/w/api.php?action=query&list=search&srsearch={q}&format=json&srlimit=10",
            json=JsonReader("query", "search", "title", "snippet", "pageid", "https://en.wikipedia.org/wiki/{title}"),
        ),
        Adapter(
            _config("Sogou", "sogou", 1.0, 5, True, False), "https://www.sogou.com/web?query={q}", "div.vrwrap, div.rb", "h3 a, .vr-title a",
            ".str-text, .str_info, .space-txt", rule="absolute", host="https://www.sogou.com",
        ),
        Adapter(
            _config("360 Search", "360", 1.0, 5, True, False), "https://www.so.com/s?q={q}", "li.res-list", "h3 a", ".res-desc, .res-rich", attrs=("data-mdurl", "href")
        ),
        Adapter(
            _config("Google", "g", 1.5, 10, True, True), "https://www.google.com/search?q={q}&hl=en", "div.g", "h3", "div[data-sncf], div.VwiC3b", link="a[href]",
            rule="result", blocked=("/sorry/index", "recaptcha"),
        ),
        Adapter(
            _config("Baidu", "baidu", 1.0, 10, True, False), "https://www.baidu.com/s?wd={q}", "div.result, div.c-container", "h3 a, .t a",
            ".c-abstract, .c-span-last, .content-right_8Zs40",
        ),
        Adapter(
            _config("Bing China", "bing_cn", 1.0, 10, True, True), "https://cn.bing.com/search?q={q}", "li.b_algo", "h2 a", ".b_caption p, .b_algoSlug", http_only=True
        ),
    )
}


def override(adapter: Adapter, **changes: object) -> Adapter:
    """An adapter with other settings, as ``weight=2.0``."""
    return replace(adapter, config=replace(adapter.config, **changes))


def with_language(adapter: Adapter, language: str) -> Adapter:
    """The encyclopedia's adapter for another language."""
    there = lambda address: address.replace("//en.", f"//{language}.")
    return replace(adapter, request=there(adapter.request), json=replace(adapter.json, page=there(adapter.json.page)))


def request_url(adapter: Adapter, query: Column) -> Column:
    before, after = adapter.request.split("{q}")
    return F.concat(F.lit(before), url_encode(query), F.lit(after))


def requests(queries: DataFrame, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """``query_id, engine_ord, engine, shortcut, request_url``: one request per query and source."""
    made = F.array(
        *(
            F.struct(
                F.lit(k).alias("engine_ord"), F.lit(a.config.name).alias("engine"), F.lit(a.config.shortcut).alias("shortcut"), request_url(a, F.col("query")).alias("request_url")
            )
            for k, a in enumerate(adapters.values())
        )
    )
    return queries.select("query_id", F.inline(made))


def registry(spark: SparkSession, adapters: dict[str, Adapter] = ADAPTERS) -> DataFrame:
    """The registry of built-in sources, in the order of registration."""
    rows = [
        (k, c.name, c.shortcut, c.categories, c.weight, c.timeout, c.enabled, c.paging, c.safesearch)
        for k, c in enumerate(a.config for a in adapters.values())
    ]
    return spark.createDataFrame(rows, REGISTRY)
