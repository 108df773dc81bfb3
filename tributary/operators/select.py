"""Which sources answer which query, and which queries are valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import is_blank
from tributary.model import InvalidQuery, NoEngines

#: Other names of shortcuts in the front ends.
ALIASES = {"duckduckgo": "ddg", "wikipedia": "wiki", "so360": "360", "google": "g", "bing": "bing_cn"}


def resolve_aliases(names: list[str]) -> list[str]:
    return [ALIASES.get(n, n) for n in names]


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries that hold more than white space."""
    return queries.filter(F.col("query").isNotNull() & ~is_blank(F.col("query")))


def select_engines(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """``query_id, engine_ord, engine``: enabled sources that each query goes to.

    A query that names shortcuts goes to those and categories don't matter; else to the
    sources that share a category with it. The wanted names are unnested and met by equi-joins
    on shortcut or category, so neither side is multiplied with the other.
    """
    enabled = registry.filter("enabled").select("engine_ord", F.col("name").alias("engine"), "shortcut", "categories")
    named = queries.filter(F.size(F.coalesce("engines", F.array())) > 0).select("query_id", F.explode("engines").alias("shortcut"))
    by_name = named.join(enabled.drop("categories"), "shortcut")
    free = queries.filter(F.size(F.coalesce("engines", F.array())) <= 0).select("query_id", F.explode("categories").alias("category"))
    offered = enabled.select("engine_ord", "engine", F.explode("categories").alias("category"))
    by_category = free.join(offered, "category")
    both = by_name.select("query_id", "engine_ord", "engine").unionAll(by_category.select("query_id", "engine_ord", "engine"))
    return both.distinct()


def refused(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """``query_id, message`` of the queries that can't be asked: all, if no source is registered, else the blank ones."""
    if registry.isEmpty():
        return queries.select("query_id", F.lit(str(NoEngines())).alias("message"))
    blank = queries.filter(F.col("query").isNull() | is_blank(F.col("query")))
    return blank.select("query_id", F.lit(str(InvalidQuery("Query cannot be empty"))).alias("message"))


def check_query(query: str, n_engines: int) -> None:
    """Raises if no source is registered, then if the query is blank."""
    if n_engines == 0:
        raise NoEngines()
    if not query.strip():
        raise InvalidQuery("Query cannot be empty")
