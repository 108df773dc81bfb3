"""Rank fusion: merge, score and order the ranked lists of many sources, for many queries at once.

One grouping on ``(query, normalised url)`` with partial aggregation does it all. The
order in which a sequential merge would meet rows is the column triple
``(engine_ord, pos, row)``; "first" and "longest" are minima and maxima over it, so the
result depends neither on partitioning nor on input order.

* url and type are the first row's; title and content the longest in bytes, the earliest of
  these; thumbnail and date the first that is not null;
* ``W`` is the product of the weights of the distinct sources times their number;
* the score is the sum of ``W / position`` (normal), ``W`` times the positions (high) or 0 (low).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import normalized_url

#: Registry rows up to which weights are broadcast; a larger table is joined by Spark's own choice.
SMALL_REGISTRY = 100_000


def weight_table(registry: DataFrame) -> DataFrame:
    """``engine, weight``: of registrations under one name the last counts."""
    return registry.groupBy(F.col("name").alias("engine")).agg(F.max_by("weight", "engine_ord").alias("weight"))


def with_weights(results: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Results with ``weight``; sources without one have 1."""
    if weights is None:
        return results.withColumn("weight", F.lit(1.0))
    small = weights.select("engine", F.col("weight").alias("_w"))
    if small.limit(SMALL_REGISTRY + 1).count() <= SMALL_REGISTRY:
        small = F.broadcast(small)
    return results.join(small, "engine", "left").withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_w")


def consensus_weight(pairs: Column) -> Column:
    """Product of the weights of distinct ``struct(engine, weight)`` pairs, times their number."""
    return F.aggregate(F.array_sort(pairs), F.lit(1.0), lambda a, s: a * s["weight"]) * F.size(pairs)


SEEDS = ("seed_engines", "seed_positions")


def _with_seeds(out: DataFrame, weights: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Adds the engines that the first row of each key already carried to those that found it."""
    named = out.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "key"])), F.explode("seed_engines").alias("engine")).filter("engine is not null")
    carried = with_weights(named, weights).groupBy(*(f"_k{i}" for i in range(len(by) + 1))).agg(F.collect_set(F.struct("engine", "weight")).alias("_carried"))
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "key"])))
    both = F.when(F.col("_carried").isNull(), F.col("found")).otherwise(F.array_union("found", "_carried"))
    return out.join(carried, on, "left").withColumn("found", both)


def fuse(results: DataFrame, weights: DataFrame | None = None, *, priority: str = "normal", by: Sequence[str] = ("query_id",), row: str | None = None) -> DataFrame:
    """Fused results: ``<by>, key, url, title, content, result_type, thumbnail, published_date,
    engines, positions, score, first_ord, first_pos``.

    ``results`` has ``engine_ord, engine, pos, url, title, content`` and optionally
    ``result_type, thumbnail, published_date``; ``row`` names a column that orders rows of
    equal ``(engine_ord, pos)``. Rows with a null url or position are left out; null titles
    and contents count as empty. ``seed_engines array<string>`` and ``seed_positions array<int>`` are
    what a row already carries: those of the first row of a key count as found before all others.
    """
    optional = {"result_type": F.lit("web"), "thumbnail": F.lit(None).cast("string"), "published_date": F.lit(None).cast("string")}
    rows = with_weights(results, weights).filter(F.col("url").isNotNull() & F.col("pos").isNotNull())
    rows = rows.select(
        *by,
        normalized_url(F.col("url")).alias("key"),
        F.struct(F.col("engine_ord").cast("int").alias("ord"), F.col("pos").cast("int").alias("pos"), (F.col(row) if row else F.lit(0)).alias("row")).alias("at"),
        "engine",
        "weight",
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        *((F.col(c) if c in results.columns else d).alias(c) for c, d in optional.items()),
        *(c for c in SEEDS if c in results.columns),
    )
    seeds = [c for c in SEEDS if c in results.columns]
    # minima of structs that begin with the place: rows at one place are told apart by their values, never by chance.
    # Of the longest values the earliest: lengths descend, places ascend
    longest = lambda c: F.min(F.struct((-F.octet_length(c)).alias("n"), "at", c))[c]
    present = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c]
    out = rows.groupBy(*by, "key").agg(
        F.min(F.struct("at", "url", "result_type", *seeds)).alias("head"),
        longest("title").alias("title"),
        longest("content").alias("content"),
        present("thumbnail").alias("thumbnail"),
        present("published_date").alias("published_date"),
        F.collect_set(F.struct("engine", "weight")).alias("found"),
        F.collect_list("at").alias("places"),
    )
    out = out.withColumns({"first": F.col("head.at"), **{c: F.col(f"head.{c}") for c in ("url", "result_type", *seeds)}})
    positions = F.transform(F.array_sort("places"), lambda p: p["pos"])
    if "seed_positions" in out.columns:
        positions = F.concat(F.coalesce(F.col("seed_positions").cast("array<int>"), F.array().cast("array<int>")), positions)
    if "seed_engines" in out.columns:
        out = _with_seeds(out, weights, by)
    w = consensus_weight(F.col("found"))
    scores = {
        "normal": F.aggregate(F.col("positions"), F.lit(0.0), lambda a, p: a + F.col("w") / p),
        "high": F.col("w") * F.size("positions"),
        "low": F.lit(0.0),
    }
    out = out.withColumns({"positions": positions, "w": w}).withColumn("score", scores[priority])
    engines = F.array_sort(F.transform("found", lambda s: s["engine"]))
    return out.select(
        *by, "key", "url", "title", "content", "result_type", "thumbnail", "published_date", engines.alias("engines"), "positions", "score",
        F.col("first.ord").alias("first_ord"), F.col("first.pos").alias("first_pos"),
    )


def fused_scores(results: DataFrame, weights: DataFrame | None = None, *, priority: str = "normal", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``<by>, key, n_engines, n_positions, score, best``: scores alone.

    Two groupings of numbers, both hash-aggregated in generated code, that keep no
    list of positions: for groups of any size. The first sums what one source adds to a key,
    so a key found millions of times is small before it is brought together.
    """
    rows = with_weights(results, weights).filter(F.col("url").isNotNull() & F.col("pos").isNotNull())
    per = rows.groupBy(*by, normalized_url(F.col("url")).alias("key"), "engine").agg(
        F.max("weight").alias("weight"), F.count("*").alias("n"), F.sum(1.0 / F.col("pos")).alias("inverse"), F.min("pos").alias("best")
    )
    zero, minus = F.col("weight") == 0, F.col("weight") < 0
    log = F.sum(F.when(zero, 0.0).otherwise(F.ln(F.abs("weight"))))
    sign = F.when(F.max(zero.cast("int")) > 0, 0.0).when(F.sum(minus.cast("int")) % 2 == 1, -1.0).otherwise(1.0)
    out = per.groupBy(*by, "key").agg(
        F.count("*").alias("n_engines"), F.sum("n").alias("n_positions"), F.sum("inverse").alias("inverse"), F.min("best").alias("best"), (sign * F.exp(log)).alias("product")
    )
    w = F.col("product") * F.col("n_engines")
    score = {"normal": w * F.col("inverse"), "high": w * F.col("n_positions"), "low": F.lit(0.0)}[priority]
    return out.select(*by, "key", "n_engines", "n_positions", score.alias("score"), "best")
