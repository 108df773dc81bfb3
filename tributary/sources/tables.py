"""Any table as ranked lists, and the source contract."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.model import EngineConfig
from tributary.operators.rank import enumerate_positions, first_positions


class RankedSource(Protocol):
    """A source: its settings, and its ranked rows for a table of queries."""

    config: EngineConfig

    def rank(self, queries: DataFrame) -> DataFrame:
        """``query_id, pos, url, title, content`` and optionally the other columns of a result."""


class FixedSource:
    """A source that answers every query with the same list; for tests and demonstrations."""

    def __init__(self, config: EngineConfig, rows: Sequence[tuple[str, str, str]] = (), error: str | None = None) -> None:
        self.config, self.rows, self.error = config, list(rows), error

    def rank(self, queries: DataFrame) -> DataFrame:
        if self.error is not None:
            raise RuntimeError(self.error)
        kind = "array<struct<pos: int, url: string, title: string, content: string>>"
        listed = F.array(*(F.struct(F.lit(i + 1), *map(F.lit, r)) for i, r in enumerate(self.rows))).cast(kind)
        return queries.select("query_id", F.inline(listed))


class TableSource:
    """A source over a table that holds each query's rows, ordered by ``order``."""

    def __init__(self, config: EngineConfig, rows: DataFrame, order: Sequence[Column]) -> None:
        self.config, self.rows, self.order = config, rows, list(order)

    def rank(self, queries: DataFrame) -> DataFrame:
        mine = self.rows.join(queries.select("query_id"), "query_id", "left_semi")
        return enumerate_positions(mine, by=["query_id"], order=self.order)


def ranked_table(df: DataFrame, *, query: Sequence[Column], engine: Column, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """``df`` as ranked lists: ``pos`` within each query and engine, the first ``limit`` kept."""
    keyed = df.withColumn("engine", engine)
    for k, c in enumerate(query):
        keyed = keyed.withColumn("query_id" if not k else f"query_id{k}", c)
    by = ["engine", *("query_id" if not k else f"query_id{k}" for k in range(len(query)))]
    return enumerate_positions(keyed, by=by, order=order) if limit is None else first_positions(keyed, limit, by=by, order=order)
