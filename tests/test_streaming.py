"""Streams over arriving files: late rows, restarts, and recomputing only what a batch touches."""

from datetime import datetime

from pyspark.sql import functions as F

from cytoloom.streaming import arrivals

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def put(spark, folder, rows):
    spark.createDataFrame([(i, datetime(2024, 1, d, h), k, v) for i, d, h, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_windows_close_late_rows_go_and_restart(spark, tmp_path):
    folder, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    run = lambda: arrivals.run_stream(spark, folder, SCHEMA, out, at)
    seen = lambda: {(r.start.day, r.event_type, r.n, r.total) for r in spark.read.parquet(out).collect()}
    put(spark, folder, [(1, 1, 5, "a", 1.0), (2, 1, 6, "a", 2.0), (3, 2, 1, "b", 4.0)])
    put(spark, folder, [(4, 9, 1, "a", 8.0)])
    run()
    put(spark, folder, [(5, 10, 1, "a", 1.0)])  # moves the watermark on
    run()
    assert seen() == {(1, "a", 2, 3.0), (2, "b", 1, 4.0)}
    put(spark, folder, [(6, 1, 7, "a", 100.0), (7, 9, 2, "a", 16.0), (8, 20, 1, "c", 0.0)])  # the first is too late, the second isn't
    run()
    put(spark, folder, [(9, 21, 1, "c", 0.0)])
    run()
    assert seen() == {(1, "a", 2, 3.0), (2, "b", 1, 4.0), (9, "a", 2, 24.0), (10, "a", 1, 1.0)}
    run()  # nothing new
    assert spark.read.parquet(out).count() == 4


def test_only_touched_keys_are_recomputed(spark, tmp_path):
    folder, to = f"file://{tmp_path}/in", f"file://{tmp_path}/to"
    touched = []

    def total(d):
        touched.append({r[0] for r in d.select("event_type").distinct().collect()})
        return d.groupBy("event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))

    run = lambda: arrivals.follow(spark, folder, SCHEMA, "event_type", total, to, files=10)
    seen = lambda: {tuple(r) for r in arrivals.results(spark, to, "event_type").collect()}
    put(spark, folder, [(1, 1, 1, "a", 1.0), (2, 1, 1, "b", 2.0), (3, 1, 1, None, 9.0)])
    run()
    assert seen() == {("a", 1.0, 1), ("b", 2.0, 1)}
    put(spark, folder, [(4, 1, 2, "b", 3.0), (5, 1, 2, "c", 4.0)])
    run()
    assert seen() == {("a", 1.0, 1), ("b", 5.0, 2), ("c", 4.0, 1)} and touched[-1] == {"b", "c"}

    def fails(d):
        raise RuntimeError("lost")

    put(spark, folder, [(6, 1, 3, "a", 10.0)])
    try:
        arrivals.follow(spark, folder, SCHEMA, "event_type", fails, to, files=10)
        raise AssertionError("the failure is passed on")
    except Exception as e:
        assert "lost" in str(e)
    run()  # the same batch again: its rows count once
    assert seen() == {("a", 11.0, 2), ("b", 5.0, 2), ("c", 4.0, 1)} and touched[-1] == {"a"}
