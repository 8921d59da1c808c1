"""Reporting tables: O188 to O198."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import CELLS, FEATURES, PATIENTS, query


def clinical_table(p: DataFrame, by: str) -> DataFrame:
    """O188, O131: n, events n (%), follow-up median (IQR)."""
    q = [F.percentile("time", F.lit(x)) for x in (0.5, 0.25, 0.75)]
    n, e = F.count(F.lit(1)), F.count_if("event")
    return p.groupBy(by).agg(n.alias("n"), F.format_string("%d (%.1f%%)", e, 100.0 * e / n).alias("events"), F.format_string("%.2f (%.2f-%.2f)", *q).alias("follow_up"))


def lump_minor(df: DataFrame, label: str, k: int) -> DataFrame:
    """O192: labels beyond the k most frequent become Other."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = n.withColumn("_k", F.row_number().over(Window.orderBy(F.desc("_n"), label))).where(F.col("_k") <= k).select(label, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), label, "left").withColumn(label, F.when(F.col("_top"), F.col(label)).otherwise("Other")).drop("_top")


@query("o188_clinical_table", f"WITH {PATIENTS} SELECT cohort, count(*) AS n, count(*) FILTER (WHERE event) || ' (' || printf('%.1f', 100.0 * count(*) FILTER (WHERE event) / count(*)) || '%)' AS events, printf('%.2f', median(time)) || ' (' || printf('%.2f', quantile_cont(time, 0.25)) || '-' || printf('%.2f', quantile_cont(time, 0.75)) || ')' AS follow_up FROM patients GROUP BY 1")
def _o188(t):
    return clinical_table(t.patients(), "cohort")


@query("o190_transposed_table", f"WITH {PATIENTS}, l AS (SELECT 'n' AS item, cohort, count(*)::DOUBLE AS v FROM patients GROUP BY cohort UNION ALL SELECT 'events', cohort, count(*) FILTER (WHERE event) FROM patients GROUP BY cohort) SELECT item, max(v) FILTER (WHERE cohort = 'BUILDING') AS building, max(v) FILTER (WHERE cohort = 'MACHINERY') AS machinery FROM l GROUP BY 1")
def _o190(t):
    g = t.patients().groupBy("cohort").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("event").cast("double").alias("events"))
    return g.unpivot(["cohort"], ["n", "events"], "item", "v").groupBy("item").pivot("cohort", ["BUILDING", "MACHINERY"]).agg(F.max("v")).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("o191_feature_inventory", f"WITH {FEATURES}, n AS (SELECT count(DISTINCT patient_id) AS n FROM features), c AS (SELECT split_part(feature, '_', 1) AS family, feature, count(value) AS k FROM features GROUP BY ALL) SELECT family, count(*) AS n_features, count(*) FILTER (WHERE k = n) AS n_in_all, round(median(k / n::DOUBLE), 9) AS median_coverage FROM c, n GROUP BY 1")
def _o191(t):
    f = t.features()
    n = F.broadcast(f.agg(F.count_distinct("patient_id").alias("n")))
    c = f.groupBy(F.substring_index("feature", "_", 1).alias("family"), "feature").agg(F.count("value").alias("k")).join(n, F.lit(True))
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("k") == F.col("n")).alias("n_in_all"), F.round(F.median(F.col("k") / F.col("n")), 9).alias("median_coverage"))


@query("o192_label_audit", f"WITH {CELLS}, n AS (SELECT phenotype, row_number() OVER (ORDER BY count(*) DESC, phenotype) AS k FROM cells GROUP BY 1) SELECT CASE WHEN k <= 3 THEN phenotype ELSE 'Other' END AS phenotype, region, count(*) AS n FROM cells JOIN n USING (phenotype) GROUP BY ALL")
def _o192(t):
    return lump_minor(t.cells(), "phenotype", 3).groupBy("phenotype", "region").agg(F.count(F.lit(1)).alias("n"))


@query("o195_combination_audit", "SELECT p_brand, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY p_brand), 9) AS share FROM part GROUP BY ALL".replace("count(*) / sum(count(*)) OVER (PARTITION BY p_brand)", "n / sum(n) OVER (PARTITION BY p_brand)").replace("FROM part GROUP BY ALL", "FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)").replace("p_type, count(*) AS n, round", "p_type, n, round"))
def _o195(t):
    g = t("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")), 9))


@query("o197_transform_comparison", "SELECT l_suppkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A') - avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS difference FROM lineitem GROUP BY 1")
def _o197(t):
    g = t("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N"]).agg(F.avg("l_quantity"))
    return g.select("l_suppkey", F.round(F.col("A") - F.col("N"), 6).alias("difference"))


@query("o198_alignment_report", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT c_mktsegment AS cohort, count(*) AS n, count(a.k) AS shared FROM customer LEFT JOIN a ON a.k = c_custkey GROUP BY 1")
def _o198(t):
    a = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return t("customer").join(a, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("shared"))
