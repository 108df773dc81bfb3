"""Proxy lists: parsing, rendering, rotation, and their assignment to requests in bulk."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import proxy_url
from tributary.model import SearchError, UrlError
from tributary.operators.rank import range_positions

#: Protocols and their ports where a url names none.
DEFAULT_PORTS = {"http": 8080, "https": 443, "socks5": 1080}


@dataclass(frozen=True)
class Proxy:
    host: str
    port: int
    protocol: str = "http"
    username: str | None = None
    password: str | None = None

    @property
    def url(self) -> str:
        auth = f"{self.username}:{self.password}@" if self.username is not None and self.password is not None else ""
        return f"{self.protocol}://{auth}{self.host}:{self.port}"

    @classmethod
    def parse(cls, url: str) -> Proxy:
        """From a url; user and password count only together."""
        parts = urlsplit(url)
        if not parts.scheme or not parts.netloc:
            raise UrlError(f"relative URL without a base: {url}")
        if parts.scheme not in DEFAULT_PORTS:
            raise SearchError(f"Unsupported proxy protocol: {parts.scheme}")
        try:
            port, host = parts.port, parts.hostname
        except ValueError as e:
            raise UrlError(e) from e
        if not host:
            raise UrlError("empty host")
        if port is None or (parts.scheme, port) == ("http", 80):
            port = DEFAULT_PORTS[parts.scheme]
        if parts.password is None:
            return cls(host, port, parts.scheme)
        return cls(host, port, parts.scheme, unquote(parts.username or ""), unquote(parts.password))


@dataclass(frozen=True)
class ProxyProvider:
    """Where a pool's proxies come from, and after how many seconds they are worth asking for again."""

    fetch: Callable[[], list[Proxy]]
    refresh_interval: float = 300.0

    @classmethod
    def static(cls, proxies: list[Proxy]) -> ProxyProvider:
        """A list that never changes."""
        own = list(proxies)
        return cls(lambda: list(own), float("inf"))


class ProxyPool:
    """A list of proxies handed out in turn, or by the clock."""

    def __init__(self, proxies: list[Proxy] | None = None, *, provider: ProxyProvider | Callable[[], list[Proxy]] | None = None, strategy: str = "round_robin") -> None:
        self.proxies = list(proxies or [])
        self.provider = provider if provider is None or isinstance(provider, ProxyProvider) else ProxyProvider(provider)
        self.strategy = strategy
        self.enabled = bool(self.proxies) or provider is not None
        self._next = 0

    def __len__(self) -> int:
        return len(self.proxies)

    def get(self) -> Proxy | None:
        if not self.enabled or not self.proxies:
            return None
        if self.strategy == "random":
            return self.proxies[time.time_ns() % len(self.proxies)]
        out = self.proxies[self._next % len(self.proxies)]
        self._next += 1
        return out

    def add(self, proxy: Proxy) -> None:
        self.proxies.append(proxy)

    def remove(self, host: str, port: int) -> None:
        """Removes every proxy at an address, whatever its protocol."""
        self.proxies = [p for p in self.proxies if (p.host, p.port) != (host, port)]

    def refresh(self) -> None:
        if self.provider is not None:
            self.proxies = list(self.provider.fetch())


def assign_round_robin(requests: DataFrame, pool: ProxyPool, *, key: str) -> DataFrame:
    """Requests with ``proxy``, in turn in the order of the unique column ``key``; null if the pool gives none.

    Rows are numbered by ranges of the key, so no task sees all of them.
    """
    if not pool.enabled or not len(pool):
        return requests.withColumn("proxy", F.lit(None).cast("string"))
    urls = F.array(*(F.lit(p.url) for p in pool.proxies))
    numbered = range_positions(requests, order=[F.asc(key)], pos="_turn")
    return numbered.select(*requests.columns, F.element_at(urls, (F.pmod(F.col("_turn") - 1, F.lit(len(pool))) + 1).cast("int")).alias("proxy"))


def without(proxies: DataFrame, removed: DataFrame) -> DataFrame:
    """A table of proxies without those at the addresses ``host, port`` of another, whatever their protocol."""
    return proxies.join(removed.select("host", "port").distinct(), ["host", "port"], "left_anti").select(*proxies.columns)


def rendered(proxies: DataFrame) -> DataFrame:
    """A table of proxies with ``proxy_url``."""
    return proxies.withColumn("proxy_url", proxy_url(F.col("protocol"), F.col("host"), F.col("port"), F.col("username"), F.col("password")))
