"""Fusion of a stream of ranked rows; an extension, a query itself is one-shot.

Rows arrive in micro-batches. Each batch is appended to a state table in the folder given,
partitioned by a hash of the query, and the queries it touches are fused again over all their
rows, so late and repeated rows lead to the same result as one batch would. Only the
partitions of touched queries are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.operators.fuse import fuse


#: Partitions of the state table.
BUCKETS = 256


def fuse_stream(rows: DataFrame, folder: str, *, weights: DataFrame | None = None, row: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a query that keeps ``folder/fused/batch=<n>`` with the fused results of each batch's queries."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        kind = batch.schema["query_id"].dataType.simpleString()
        # a batch that is run again after a failure overwrites its own part
        part = F.pmod(F.xxhash64("query_id"), F.lit(buckets)).cast("int")
        batch.withColumn("bucket", part).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/batch={n}")
        touched = spark.read.schema(f"query_id {kind}, bucket int").parquet(f"{folder}/rows/batch={n}").distinct()
        at = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most ``buckets``
        seen = spark.read.parquet(f"{folder}/rows").filter((F.col("batch") <= n) & F.col("bucket").isin(at)).drop("batch", "bucket")
        fused = fuse(seen.join(touched.select("query_id"), "query_id", "left_semi"), weights, row=row)
        fused.write.mode("overwrite").parquet(f"{folder}/fused/batch={n}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def current(folder: str, spark) -> DataFrame:
    """The latest fused results of every query."""
    fused = spark.read.parquet(f"{folder}/fused")
    latest = fused.groupBy("query_id").agg(F.max("batch").alias("batch"))
    return fused.join(latest, ["query_id", "batch"]).drop("batch")


def late_counts(rows: DataFrame, *, event: str = "fetched_at", delay: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Rows per source and window of event time; rows later than ``delay`` behind the watermark are left out."""
    timed = rows.withWatermark(event, delay)
    return timed.groupBy(F.window(event, window), "engine").agg(F.count("*").alias("n"), F.sum(1.0 / F.col("pos")).alias("inverse"))
