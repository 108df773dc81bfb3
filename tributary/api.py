"""The facade: register sources, run one query, get a response."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.model import QUERY, EngineErrorInfo, SearchError, SearchQuery, SearchResponse, SearchResult
from tributary.operators.fuse import fuse
from tributary.operators.rank import ordered
from tributary.operators.select import check_query, resolve_aliases
from tributary.plans.storage import cut_lineage
from tributary.proxy import Proxy, ProxyPool
from tributary.sources.tables import RankedSource


class Federation:
    """Sources in order of registration; a weight belongs to a display name, the last one given counts."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.sources: list[RankedSource] = []
        self.timeout = 5  # kept for callers; each source's own timeout is the one that holds
        self.proxy_pool: ProxyPool | None = None

    def add_engine(self, source: RankedSource) -> None:
        self.sources.append(source)

    @property
    def engine_count(self) -> int:
        return len(self.sources)

    def select(self, query: SearchQuery) -> list[tuple[int, RankedSource]]:
        """Enabled sources by shortcut if the query names some, else by common category."""
        on = [(k, s) for k, s in enumerate(self.sources) if s.config.enabled]
        if query.engines:
            return [(k, s) for k, s in on if s.config.shortcut in query.engines]
        return [(k, s) for k, s in on if set(query.categories) & set(s.config.categories)]

    def fused(self, query: SearchQuery) -> tuple[DataFrame | None, list[EngineErrorInfo]]:
        """The fused results as a table, and the sources that failed."""
        check_query(query.query, len(self.sources))
        asked = self.spark.createDataFrame([(0, query.query, query.categories, query.language, query.safesearch, query.page, query.time_range, query.engines)], QUERY)
        lists, errors = [], []
        for k, source in self.select(query):
            try:
                # run here, so that a source that fails only when it is read costs the others nothing
                ranked = cut_lineage(source.rank(asked))
                lists.append(ranked.withColumns({"engine": F.lit(source.config.name), "engine_ord": F.lit(k)}))
            except Exception as e:  # noqa: BLE001 - one failed source never fails the search
                errors.append(EngineErrorInfo(source.config.name, reason(e)))
        if not lists:
            return None, errors
        named = {s.config.name: float(s.config.weight) for s in self.sources}
        weights = self.spark.createDataFrame(list(named.items()), "engine string, weight double")
        return fuse(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists), weights), errors

    def ask(self, query: SearchQuery | str, *, limit: int | None = None, count_before_limit: bool = True) -> SearchResponse:
        """Runs one query. ``count`` is taken before the limit, or after it as in the client libraries."""
        began = time.monotonic()
        query = SearchQuery(query) if isinstance(query, str) else query
        fused, errors = self.fused(query)
        response = SearchResponse(errors=errors)
        if fused is not None:
            best = fused.orderBy(*ordered(fused))
            rows = (best if limit is None else best.limit(limit)).collect()
            names = ("url", "title", "content", "result_type", "engines", "positions", "score", "thumbnail", "published_date")
            response.results = [SearchResult(**{n: r[n] for n in names}) for r in rows]
            response.count = fused.count() if count_before_limit and limit is not None else len(rows)
        response.duration_ms = int((time.monotonic() - began) * 1000)
        return response


def reason(e: Exception) -> str:
    """What went wrong in a source: of an error raised in a Python worker, its own last line."""
    text = str(e).strip()
    lines = [x.strip() for x in text.split("JVM stacktrace")[0].splitlines() if x.strip() and not x.strip().startswith("at ")]
    own = [x for x in lines if re.match(r"\w+(\.\w+)*(Error|Exception): ", x)]
    return re.sub(r"^[\w.]+: ", "", own[-1]) if own else (lines[0] if lines else type(e).__name__)


#: The sources that clients know, and those they ask by default.
CLIENT_ENGINES, CLIENT_DEFAULT, CLIENT_TIMEOUT = ("ddg", "brave", "wiki", "sogou", "360"), ("ddg", "wiki"), 10


class Client:
    """As the client libraries: checks first, refuses unknown sources, counts after the limit.

    ``sources`` are those of the five HTTP sources that are at hand, by shortcut.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, RankedSource]) -> None:
        self.spark, self.sources = spark, {k: v for k, v in sources.items() if k in CLIENT_ENGINES}

    def search(self, query: str, *, engines: list[str] | None = None, limit: int | None = None, timeout: int | None = None, proxy: str | None = None) -> SearchResponse:
        if not query.strip():
            raise SearchError("Query cannot be empty")
        if proxy is not None:
            Proxy.parse(proxy)
        given_names = list(CLIENT_DEFAULT) if engines is None else engines
        names = resolve_aliases(given_names)
        try:
            for given, n in zip(given_names, names, strict=True):
                if n not in CLIENT_ENGINES:
                    raise SearchError(f"Unknown engine '{given}'. Available: {', '.join(CLIENT_ENGINES)}")
            if not names:
                raise SearchError("No valid engines specified")
            federation = Federation(self.spark)
            for n in names:
                if n in self.sources:
                    federation.add_engine(self.sources[n])
            federation.timeout = CLIENT_TIMEOUT if timeout is None else timeout
            return federation.ask(query, limit=limit, count_before_limit=False)
        except SearchError as e:
            raise SearchError(f"Search failed: {e}") from e
