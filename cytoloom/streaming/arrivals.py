"""Streaming (O200): windowed counts with a watermark over arriving events, and results by key that follow arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.scratch import new_path


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by time window and type; the same plan for a stream and for a table."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> None:
    """Reads all files of a folder as a stream and appends closed windows to parquet; restarts from its checkpoint. Rows later than the watermark allows are dropped."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)
    q = windowed(s).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def follow(spark: SparkSession, folder: str, schema, key: str, recompute: Callable[[DataFrame], DataFrame], to: str, files: int = 4) -> None:
    """Takes a folder's new files in batches and recomputes the keys (samples) that each batch touches, over all their rows so far; see `results`.

    recompute: from rows to results, with a column of the key. Under `to` lie the rows and results of each batch, by its number, and the
    checkpoint: a batch that is run again after a failure replaces its own folders, and a later call goes on with the files that came since.
    Rows whose key is null are kept but give no results.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{to}/rows/batch={number}")
        mine = session.read.schema(rows.schema).parquet(f"{to}/rows/batch={number}").select(key).where(F.col(key).isNotNull()).distinct()
        # folders of later numbers can only be left over from a run that was given up
        every = session.read.schema(rows.schema.add("batch", "long")).parquet(f"{to}/rows").where(F.col("batch") <= number).drop("batch")
        recompute(every.join(mine, key, "left_semi")).write.mode("overwrite").parquet(f"{to}/results/batch={number}")

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    s.writeStream.foreachBatch(batch).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def results(spark: SparkSession, to: str, key: str) -> DataFrame:
    """Each key's results of the last batch that touched it."""
    r = spark.read.parquet(f"{to}/results")
    return r.withColumn("newest", F.max("batch").over(Window.partitionBy(key))).where("batch = newest").drop("batch", "newest")


@query("o200_windowed_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _o200(t):
    return windowed(t("events"))


@query("o200_touched_keys", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY ALL")
def _o200_touched(t):
    """Events as arriving files: figures of each user and type, as of the last batch that touched the user."""
    e, to = t("events"), new_path(t.spark, "arrivals")
    e.repartitionByRange(12, "ts").write.parquet(f"{to}/arriving")
    count = lambda d: d.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))
    follow(t.spark, f"{to}/arriving", e.schema, "user_id", count, to)
    return results(t.spark, to, "user_id")
