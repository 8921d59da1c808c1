"""Operator 4. Token counts: exact length histogram.

Each task encodes whole texts and keeps a count for each length; counts are added up by length. Suffix sums over the histogram, in two
levels (buckets of lengths, then lengths in a bucket), answer totals, quantiles and truncated totals for every context limit, since
between two lengths all of these are constant or linear in the limit.

Null and empty texts have length 0. An empty table gives no rows. Repeated rows count as often as they occur; documents of one length are one
row. Texts of any length are encoded whole. No column but text is read, so extra ones, whatever their names, change nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import blocks, encoding, materialise, table

#: Lengths in a bucket of the upper level.
BUCKET = 1024


def lengths(docs: DataFrame, ranks: str | None = None, added: str | None = None) -> DataFrame:
    """(length, n_docs) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoding(ranks, added), Counter()
        for b in blocks(batches, 0):
            seen.update(len(enc(t or "")) for t in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def histogram(docs: DataFrame, ranks: str | None = None, added: str | None = None) -> DataFrame:
    """One row per occurring length, read as a context limit.

    n_docs: of this length. docs_at_least, tokens_at_least: of documents this long or longer. docs_cut: of longer ones.
    truncated_tokens: sum of min(length, limit). quantile: share of documents no longer. total_docs, total_tokens: over all.
    """
    h = materialise(lengths(docs, ranks, added), "lengths").withColumn("bucket", F.floor(F.col("length") / BUCKET)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    up = Window.orderBy(F.desc("bucket"))
    top = h.groupBy("bucket").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    every = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top.select("bucket", (F.sum("bd").over(up) - F.col("bd")).alias("above_docs"), (F.sum("bt").over(up) - F.col("bt")).alias("above_tokens"), F.sum("bd").over(every).alias("total_docs"), F.sum("bt").over(every).alias("total_tokens"))
    w = Window.partitionBy("bucket").orderBy(F.desc("length"))
    h = h.join(top, "bucket").withColumn("docs_at_least", F.sum("n_docs").over(w) + F.col("above_docs")).withColumn("tokens_at_least", F.sum("tokens").over(w) + F.col("above_tokens"))
    cut = F.col("docs_at_least") - F.col("n_docs")
    return h.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("docs_cut"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("total_docs") - cut) / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens",
    )


def truncated_total(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """(context_limit, docs_cut, truncated_tokens) for any limits: each reads off the least longer length, in one pass down the histogram."""
    at = hist.select(F.col("length").alias("key"), F.lit(1).alias("kind"), F.struct("docs_at_least", "tokens_at_least").alias("x"), "total_tokens")
    ask = limits.select(F.col("context_limit").alias("key")).distinct().select("key", F.lit(0).alias("kind"), F.lit(None).cast(at.schema["x"].dataType).alias("x"), F.lit(None).cast("long").alias("total_tokens"))
    down = Window.orderBy(F.desc("key"), "kind")
    whole = Window.orderBy(F.desc("key"), "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = at.unionByName(ask).withColumn("x", F.last("x", ignorenulls=True).over(down)).withColumn("total_tokens", F.max("total_tokens").over(whole)).where("kind = 0")
    cut = F.coalesce(F.col("x.docs_at_least"), F.lit(0))
    return both.select(F.col("key").alias("context_limit"), cut.alias("docs_cut"), (F.coalesce("total_tokens", F.lit(0)) - F.coalesce(F.col("x.tokens_at_least"), F.lit(0)) + F.col("key") * cut).alias("truncated_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))
