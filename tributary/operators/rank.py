"""Positions, order and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.plans.storage import cut_lineage

#: Rows of one list that a single task sorts and numbers; longer lists are numbered by ranges.
LONG_LIST = 1_000_000


def _same(by: Sequence[str]) -> Column:
    """Whether keys equal those of a table that names them _k0, _k1, ...; null equals null."""
    return reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)), F.lit(True))


def range_positions(df: DataFrame, *, by: Sequence[str] = (), order: Sequence[Column], pos: str = "pos") -> DataFrame:
    """``pos``, from 1, within lists of any length; without ``by`` the whole table is one list.

    Rows are sorted by ranges and written once, with their place in their range, so that the
    ranges are the same for all that follows. A list's rows before a range are counted
    from one row per range and list.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    runs = runs.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), "_first", "_before")
    both = placed.join(runs, (F.col("_range") == F.col("_r")) & _same(by))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return both.select(*df.columns, place.alias(pos))


def enumerate_positions(df: DataFrame, *, by: Sequence[str], order: Sequence[Column], long_list: int = LONG_LIST) -> DataFrame:
    """``pos``, from 1, of each row in the order of its source's list.

    A null key is a list of its own. Lists of more than ``long_list`` rows are numbered by
    ``range_positions``, so that no task holds one; ``order`` should be unique in a list.
    """
    short = lambda x: x.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    long = df.groupBy(*by).agg(F.count("*").alias("_size")).filter(F.col("_size") > long_list).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)))
    if long.isEmpty():
        return short(df)
    on = _same(by)
    many = range_positions(df.join(long, on, "left_semi"), by=by, order=order)
    return short(df.join(long, on, "left_anti")).unionByName(many.withColumn("pos", F.col("pos").cast("int")))


def first_positions(df: DataFrame, k: int, *, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows of each list with ``pos``; rows beyond ``k`` are dropped before they are brought together."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("pos") <= k)


def ordered(fused: DataFrame) -> list[Column]:
    """Score descending; ties by first source, first position, key. Scores are sums in a fixed order, so equal ones are equal."""
    return [F.desc("score"), F.asc("first_ord"), F.asc("first_pos"), F.asc("key")]


def top_k(fused: DataFrame, k: int | None, *, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Fused results with ``rank``, the first ``k`` of each query; all for ``None``."""
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*ordered(fused))))
    return out if k is None else out.filter(F.col("rank") <= k)


def top_results(fused: DataFrame, k: int) -> DataFrame:
    """The first ``k`` results of a single query, as a distributed top-k."""
    return fused.orderBy(*ordered(fused)).limit(k)


def limit_counts(fused: DataFrame, k: int, *, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``<by>, count_before, count_after``: numbers of results before and after the limit."""
    n = fused.groupBy(*by).agg(F.count("*").alias("count_before"))
    return n.withColumn("count_after", F.least("count_before", F.lit(k).cast("long")))
