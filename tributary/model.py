"""Rows, domains and errors of a federation of ranked sources."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

#: The domains of enumerated columns.
RESULT_TYPES = ("web", "image", "video", "news", "map", "file", "answer", "infobox", "suggestion")
CATEGORIES = ("general", "images", "videos", "news", "maps", "music", "files", "science", "social")
SAFESEARCH = ("Off", "Moderate", "Strict")
TIME_RANGES = ("Day", "Week", "Month", "Year")
PRIORITIES = ("high", "normal", "low")
OUTPUT_FORMATS = ("text", "json", "compact")

RANKED = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("engine_ord", T.IntegerType(), False),
        T.StructField("engine", T.StringType(), False),
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("result_type", T.StringType(), False),
        T.StructField("thumbnail", T.StringType(), True),
        T.StructField("published_date", T.StringType(), True),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("engine_ord", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("shortcut", T.StringType(), False),
        T.StructField("categories", T.ArrayType(T.StringType()), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("timeout", T.LongType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("paging", T.BooleanType(), False),
        T.StructField("safesearch", T.BooleanType(), False),
    ]
)

QUERY = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("query", T.StringType(), False),
        T.StructField("categories", T.ArrayType(T.StringType()), False),
        T.StructField("language", T.StringType(), True),
        T.StructField("safesearch", T.StringType(), False),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("time_range", T.StringType(), True),
        T.StructField("engines", T.ArrayType(T.StringType()), False),
    ]
)

ERRORS = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("engine", T.StringType(), False),
        T.StructField("message", T.StringType(), True),
    ]
)


class SearchError(Exception):
    """Base of all errors; ``template`` takes the detail."""

    template = "{}"

    def __init__(self, detail: object = "", *more: object) -> None:
        super().__init__(self.template.format(detail, *more))


class HttpError(SearchError):
    template = "HTTP request failed: {}"


class ParseError(SearchError):
    template = "Failed to parse response: {}"


class EngineSuspended(SearchError):
    template = "Engine '{}' is suspended until {}"


class SearchTimeout(SearchError):
    template = "Search timeout exceeded"


class NoEngines(SearchError):
    template = "No search engines configured"


class InvalidQuery(SearchError):
    template = "Invalid query: {}"


class UrlError(SearchError):
    template = "URL parsing error: {}"


class BrowserError(SearchError):
    template = "Browser error: {}"


class EngineError(SearchError):
    """A failed engine, as the facade reports it."""

    def __init__(self, engine: str, message: str) -> None:
        super().__init__(f"{engine}: {message}")
        self.engine, self.message = engine, message


@dataclass
class SearchQuery:
    """One query; ``page``, ``language``, ``safesearch`` and ``time_range`` are carried, no source reads them."""

    query: str
    categories: list[str] = field(default_factory=lambda: ["general"])
    language: str | None = None
    safesearch: str = "Off"
    page: int = 1
    time_range: str | None = None
    engines: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> SearchQuery:
        return cls(**json.loads(text))


@dataclass
class EngineConfig:
    """A registry row; ``name``, ``shortcut`` and ``categories`` have no default."""

    name: str
    shortcut: str
    categories: list[str]
    weight: float = 1.0
    timeout: int = 5
    enabled: bool = True
    paging: bool = False
    safesearch: bool = False

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        return cls(**json.loads(text))


@dataclass
class WaitStrategy:
    """How long a live fetch of a page would wait; kept as configuration, captured pages need none."""

    kind: str = "load"  # load, network_idle, selector or delay
    selector: str | None = None
    ms: int = 0


@dataclass
class SearchResult:
    """One fused result as the facade returns it."""

    url: str
    title: str
    content: str = ""
    result_type: str = "web"
    engines: list[str] = field(default_factory=list)
    positions: list[int] = field(default_factory=list)
    score: float = 0.0
    thumbnail: str | None = None
    published_date: str | None = None

    def __repr__(self) -> str:
        return f"SearchResult(title={self.title!r}, url={self.url!r}, score={self.score})"


@dataclass
class EngineErrorInfo:
    engine: str
    message: str | None


@dataclass
class SearchResponse:
    """Results, errors and counts of one search."""

    results: list[SearchResult] = field(default_factory=list)
    errors: list[EngineErrorInfo] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)
    answers: list[str] = field(default_factory=list)
    count: int = 0
    duration_ms: int = 0

    def add_result(self, result: SearchResult) -> None:
        self.results.append(result)
        self.count += 1

    def to_json(self) -> str:
        out = asdict(self)
        out["errors"] = [[e.engine, e.message] for e in self.errors]
        return json.dumps(out, ensure_ascii=False)

    def __repr__(self) -> str:
        return f"SearchResponse(count={self.count}, errors={len(self.errors)}, duration_ms={self.duration_ms})"
