"""Every query of the library with its SQL, gathered from the operator modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGSHIP = "o070_region_label_counts"
MODULES = ["cytoloom.sources.tables", "cytoloom.operators.labels", "cytoloom.operators.joins", "cytoloom.operators.aggregates", "cytoloom.operators.windows", "cytoloom.functions.scalars", "cytoloom.functions.feature_grammar", "cytoloom.operators.spatial", "cytoloom.operators.interactions", "cytoloom.operators.models", "cytoloom.operators.compression", "cytoloom.operators.reports", "cytoloom.operators.review", "cytoloom.operators.cohorts", "cytoloom.operators.programs", "cytoloom.operators.semantics", "cytoloom.operators.microcompression", "cytoloom.operators.grid", "cytoloom.operators.depth", "cytoloom.operators.shaping", "cytoloom.streaming.arrivals"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(t) under a name; t(table) reads a table of the query's folder."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        """Cells: one line item each; the supplier is the sample, the part's type the phenotype."""
        p = self("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("phenotype"))
        key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"))
        return self("lineitem").join(p, "l_partkey").select(F.col("l_suppkey").alias("sample_id"), key.alias("cell_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), F.when(F.col("l_linestatus") == "O", "Tumor").otherwise("Stroma").alias("region"), "phenotype")

    def features(self) -> DataFrame:
        """Long feature fact: a patient (supplier) has a value for each brand and measure. Discounts are added up as decimals, so that the sum doesn't follow the order of rows (as doubles where one is no such number)."""
        p = self("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        exact = F.expr("try_cast(l_discount AS decimal(20, 10))")
        disc = F.when(F.count(exact) == F.count("l_discount"), F.sum(exact).cast("double")).otherwise(F.sum("l_discount"))
        g = self("lineitem").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("patient_id"), "p_brand").agg(F.avg("l_quantity").alias("qty"), disc.alias("disc"))
        return g.select("patient_id", F.explode(F.array(F.struct(F.concat_ws("_", F.lit("qty"), "p_brand").alias("feature"), F.col("qty").alias("value")), F.struct(F.concat_ws("_", F.lit("disc"), "p_brand").alias("feature"), F.col("disc").alias("value")))).alias("f")).select("patient_id", "f.feature", "f.value")

    def evidence(self) -> DataFrame:
        """Candidates: one part each; the brand is the context."""
        return self("part").select(F.col("p_brand").alias("context"), F.col("p_partkey").alias("feature"), F.col("p_type").alias("source"), F.round(F.pmod(F.round("p_retailprice", 2), F.lit(100)) / 100, 4).alias("oof"), (F.col("p_size") / 100.0).alias("sd"), (F.col("p_partkey") % 3).alias("transform"))

    def patients(self) -> DataFrame:
        """Follow-up: days from first to last order; the event is a last order of status F."""
        o = self("orders").groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("time"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
        return self("customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("cohort"), F.col("time").cast("double").alias("time"), (F.col("last") == "F").alias("event"), F.col("c_acctbal").alias("marker"))


CELLS = "cells AS (SELECT l_suppkey AS sample_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, round(l_extendedprice * 100)::BIGINT) AS cell_id, l_quantity AS x, l_extendedprice / 2000 AS y, CASE WHEN l_linestatus = 'O' THEN 'Tumor' ELSE 'Stroma' END AS region, p_type AS phenotype FROM lineitem JOIN part ON p_partkey = l_partkey)"
FEATURES = "fb AS (SELECT l_suppkey AS patient_id, p_brand, avg(l_quantity) AS qty, sum(l_discount) AS disc FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), features AS (SELECT patient_id, 'qty_' || p_brand AS feature, qty AS value FROM fb UNION ALL SELECT patient_id, 'disc_' || p_brand, disc FROM fb)"
EVIDENCE = "evidence AS (SELECT p_brand AS context, p_partkey AS feature, p_type AS source, round((round(p_retailprice, 2) % 100) / 100, 4) AS oof, p_size / 100.0::DOUBLE AS sd, p_partkey % 3 AS transform FROM part)"
PATIENTS = "oo AS (SELECT o_custkey, date_diff('day', min(o_orderdate), max(o_orderdate)) AS time, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY ALL), patients AS (SELECT c_custkey AS patient_id, c_mktsegment AS cohort, time::DOUBLE AS time, last = 'F' AS event, c_acctbal AS marker FROM customer JOIN oo ON c_custkey = o_custkey)"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
