import datetime as dt

from tributary.operators.fuse import fuse
from tributary.streaming import fusion

SCHEMA = "query_id long, engine_ord int, engine string, pos int, url string, title string, content string, row long, fetched_at timestamp"
T0 = dt.datetime(2025, 1, 1)


def test_batches_lead_to_the_same_result(spark, tmp_path):
    rows = [(q, e, f"e{e}", p, f"https://h/{(q * p) % 4}", "t" * p, "c", q * 100 + e * 10 + p, T0) for q in range(4) for e in range(3) for p in range(1, 4)]
    folder = str(tmp_path)
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder + "/in")
        fusion.fuse_stream(spark.readStream.schema(SCHEMA).parquet(folder + "/in"), folder, row="row").awaitTermination()
    key = lambda df: sorted((r.query_id, r.key, r.title, tuple(r.positions), round(r.score, 9)) for r in df.collect())
    assert key(fusion.current(folder, spark)) == key(fuse(spark.createDataFrame(rows, SCHEMA), row="row"))


def test_late_rows_are_left_out(spark, tmp_path):
    folder = str(tmp_path)

    def run(times):
        spark.createDataFrame([(1, 0, "e", 1, "u", "t", "c", 0, t) for t in times], SCHEMA).write.mode("append").parquet(folder + "/in")
        stream = fusion.late_counts(spark.readStream.schema(SCHEMA).parquet(folder + "/in"))
        q = stream.writeStream.outputMode("append").format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    run([T0, T0 + dt.timedelta(minutes=10), T0 + dt.timedelta(hours=6)])
    run([T0 + dt.timedelta(minutes=20), T0 + dt.timedelta(hours=12)])
    got = {r.window.start: r.n for r in spark.read.parquet(folder + "/out").collect()}
    assert got[T0] == 2
