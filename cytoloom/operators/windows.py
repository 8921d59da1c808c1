"""Window functions, ranks, selection: O090 to O111."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import EVIDENCE, query
from .aggregates import average_rank


def percentile_rank(value: str, *part: str, desc: bool = False, missing: float | None = None) -> Column:
    """O091, O092: average-tie rank over the number of non-null values; missing values get a constant."""
    r = average_rank(value, *part, desc=desc) / F.count(value).over(Window.partitionBy(*part))
    return r if missing is None else F.coalesce(r, F.lit(missing))


def benjamini_hochberg(df: DataFrame, p: str, part: list[str]) -> DataFrame:
    """O095: q-values within groups; null p stays null."""
    w = Window.partitionBy(*part, F.col(p).isNull())
    q = F.col(p) * F.count(p).over(w) / F.row_number().over(w.orderBy(p))
    df = df.withColumn("_q", q)
    return df.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.desc(p)))))).drop("_q")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """O102, O103, O111: the first row of each key under a total order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def pareto_front(df: DataFrame, up: list[str], down: list[str], part: list[str]) -> DataFrame:
    """O108: rows that no other row of their group dominates."""
    a, b = df.alias("a"), df.alias("b")
    cols = [(c, ">") for c in up] + [(c, "<") for c in down]
    at = lambda s, c: F.col(f"{s}.{c}")
    same = [at("a", c).eqNullSafe(at("b", c)) for c in part]
    no_worse = [at("b", c) >= at("a", c) if o == ">" else at("b", c) <= at("a", c) for c, o in cols]
    better = [at("b", c) > at("a", c) if o == ">" else at("b", c) < at("a", c) for c, o in cols]
    cond = None
    for x in [*same, *no_worse]:
        cond = x if cond is None else cond & x
    any_better = better[0]
    for x in better[1:]:
        any_better = any_better | x
    return a.join(b, cond & any_better, "left_anti")


@query("o090_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS rn FROM orders")
def _o090(t):
    return t("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("rn"))


@query("o091_percentile_rank", f"WITH {EVIDENCE}, v AS (SELECT feature, context, CASE WHEN feature % 7 > 0 THEN oof END AS v FROM evidence) SELECT feature, round(CASE WHEN v IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY context, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY context, v) - 1) / 2.0) / count(v) OVER (PARTITION BY context) END, 9) AS pr FROM v")
def _o091(t):
    e = t.evidence().withColumn("v", F.when(F.col("feature") % 7 > 0, F.col("oof")))
    return e.select("feature", F.round(percentile_rank("v", "context", missing=0.0), 9).alias("pr"))


@query("o093_window_share", "SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share, dense_rank() OVER (ORDER BY p_brand)::INT - 1 AS brand_id FROM part")
def _o093(t):
    p = t("part")
    ids = p.select("p_brand").distinct().withColumn("brand_id", F.dense_rank().over(Window.orderBy("p_brand")) - 1)
    return p.withColumn("share", F.round(F.col("p_retailprice") / F.sum("p_retailprice").over(Window.partitionBy("p_brand")), 9)).join(F.broadcast(ids), "p_brand").select("p_partkey", "share", "brand_id")


@query("o095_benjamini_hochberg", "WITH p AS (SELECT event_id, event_type, CASE WHEN event_id % 9 > 0 THEN (value + 0.001) / (SELECT max(value) + 1 FROM events) END AS p FROM events), r AS (SELECT *, p * count(p) OVER (PARTITION BY event_type, p IS NULL) / row_number() OVER (PARTITION BY event_type, p IS NULL ORDER BY p) AS q FROM p) SELECT event_id, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY event_type, p IS NULL ORDER BY p DESC)) END, 9) AS q FROM r")
def _o095(t):
    e = t("events")
    top = F.broadcast(e.agg((F.max("value") + 1).alias("top")))
    p = e.join(top, F.lit(True)).select("event_id", "event_type", F.when(F.col("event_id") % 9 > 0, (F.col("value") + 0.001) / F.col("top")).alias("p"))
    return benjamini_hochberg(p, "p", ["event_type"]).select("event_id", F.round("q", 9).alias("q"))


@query("o096_depth_profile", f"WITH {EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY oof DESC, feature) AS k FROM evidence) SELECT context, d::INT AS depth, round(avg(oof), 6) AS mean, round(median(oof), 6) AS median, count(*) < d AS exhausted FROM r JOIN (SELECT unnest([5, 10, 20, 500]) AS d) ON k <= d GROUP BY context, d")
def _o096(t):
    r = t.evidence().withColumn("k", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("oof"), "feature")))
    r = r.withColumn("depth", F.explode(F.array(*map(F.lit, (5, 10, 20, 500))))).where("k <= depth")
    return r.groupBy("context", "depth").agg(F.round(F.avg("oof"), 6).alias("mean"), F.round(F.median("oof"), 6).alias("median"), F.count(F.lit(1)).alias("n")).select("context", "depth", "mean", "median", (F.col("n") < F.col("depth")).alias("exhausted"))


@query("o097_trailing_window_elbow", f"WITH {EVIDENCE}, r AS (SELECT context, feature, (oof > 0.5)::INT AS novel, row_number() OVER (PARTITION BY context ORDER BY oof DESC, feature) AS k FROM evidence), w AS (SELECT *, sum(novel) OVER (PARTITION BY context ORDER BY k ROWS 4 PRECEDING) AS back, sum(novel) OVER (PARTITION BY context ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM r) SELECT context, min(k) FILTER (WHERE back <= 2 AND ahead <= 2)::INT AS elbow FROM w GROUP BY 1")
def _o097(t):
    w = Window.partitionBy("context").orderBy("k")
    r = t.evidence().withColumn("k", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("oof"), "feature"))).withColumn("novel", (F.col("oof") > 0.5).cast("int"))
    r = r.withColumn("back", F.sum("novel").over(w.rowsBetween(-4, 0))).withColumn("ahead", F.sum("novel").over(w.rowsBetween(1, 5)))
    return r.groupBy("context").agg(F.min(F.when((F.col("back") <= 2) & (F.col("ahead") <= 2), F.col("k"))).alias("elbow"))


@query("o099_peak_and_area", "WITH v AS (SELECT user_id, event_id AS radius, value - 50 AS v FROM events), l AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY radius) AS pv, lag(radius) OVER (PARTITION BY user_id ORDER BY radius) AS pr FROM v) SELECT user_id, arg_max(v, (abs(v), -radius)) AS peak, round(sum((v + pv) / 2 * (radius - pr)), 4) AS area FROM l GROUP BY 1")
def _o099(t):
    w = Window.partitionBy("user_id").orderBy("radius")
    v = t("events").select("user_id", F.col("event_id").alias("radius"), (F.col("value") - 50).alias("v"))
    v = v.withColumn("part", (F.col("v") + F.lag("v").over(w)) / 2 * (F.col("radius") - F.lag("radius").over(w)))
    return v.groupBy("user_id").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("radius"))).alias("peak"), F.round(F.sum("part"), 4).alias("area"))


@query("o103_top_k_per_group", f"WITH {EVIDENCE} SELECT context, source, feature FROM evidence QUALIFY row_number() OVER (PARTITION BY context, source ORDER BY oof DESC, sd, feature) <= 3")
def _o103(t):
    return top_k(t.evidence(), ["context", "source"], [F.desc_nulls_last("oof"), F.asc_nulls_last("sd"), F.col("feature")], 3).select("context", "source", "feature")


@query("o104_capped_selection", f"WITH {EVIDENCE}, caps AS (SELECT DISTINCT p_type AS source, length(p_type) AS cap FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY oof DESC, feature) AS k FROM evidence) SELECT source, any_value(cap)::INT AS cap, count(*) AS selected, round(median(oof), 6) AS median_top FROM r JOIN caps USING (source) WHERE k <= cap GROUP BY 1")
def _o104(t):
    caps = t("part").select(F.col("p_type").alias("source"), F.length("p_type").alias("cap")).distinct()
    s = top_k(t.evidence().join(F.broadcast(caps), "source"), ["source"], [F.desc("oof"), F.col("feature")], F.col("cap"))
    return s.groupBy("source").agg(F.max("cap").alias("cap"), F.count(F.lit(1)).alias("selected"), F.round(F.median("oof"), 6).alias("median_top"))


@query("o106_soft_family_caps", f"WITH {EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY context, source ORDER BY oof DESC, feature) <= 4 AS capped FROM evidence) SELECT context, feature FROM r QUALIFY row_number() OVER (PARTITION BY context ORDER BY capped DESC, oof DESC, feature) <= 30")
def _o106(t):
    e = t.evidence().withColumn("capped", F.row_number().over(Window.partitionBy("context", "source").orderBy(F.desc("oof"), "feature")) <= 4)
    return top_k(e, ["context"], [F.desc("capped"), F.desc("oof"), F.col("feature")], 30).select("context", "feature")


@query("o107_nested_quotas", f"WITH {EVIDENCE}, a AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY context, source ORDER BY oof DESC, feature) <= 3) SELECT context, source, feature FROM a QUALIFY row_number() OVER (PARTITION BY context ORDER BY oof DESC, feature) <= 10")
def _o107(t):
    order = [F.desc("oof"), F.col("feature")]
    return top_k(top_k(t.evidence(), ["context", "source"], order, 3), ["context"], order, 10).select("context", "source", "feature")


@query("o108_pareto_front", f"WITH {EVIDENCE} SELECT a.feature FROM evidence a WHERE NOT EXISTS (SELECT 1 FROM evidence b WHERE b.context = a.context AND b.oof >= a.oof AND b.sd <= a.sd AND (b.oof > a.oof OR b.sd < a.sd))")
def _o108(t):
    return pareto_front(t.evidence(), ["oof"], ["sd"], ["context"]).select("feature")


@query("o109_best_transform", f"WITH {EVIDENCE}, w AS (SELECT *, max(oof) OVER (PARTITION BY context, source) AS m FROM evidence), s AS (SELECT *, min(sd) OVER (PARTITION BY context, source) AS ms FROM w WHERE round(m - oof, 6) < 0.01) SELECT context, source, feature FROM s WHERE round(sd - ms, 6) < 0.02 QUALIFY row_number() OVER (PARTITION BY context, source ORDER BY transform, oof DESC, feature) = 1")
def _o109(t):
    g = Window.partitionBy("context", "source")
    near = t.evidence().withColumn("m", F.max("oof").over(g)).where(F.round(F.col("m") - F.col("oof"), 6) < 0.01)
    calm = near.withColumn("ms", F.min("sd").over(g)).where(F.round(F.col("sd") - F.col("ms"), 6) < 0.02)
    return keep_first(calm, ["context", "source"], [F.col("transform"), F.desc("oof"), F.col("feature")]).select("context", "source", "feature")


@query("o110_plateau_filter", f"WITH {EVIDENCE}, g AS (SELECT context, thr, oof, row_number() OVER (PARTITION BY context, thr ORDER BY oof DESC, feature) AS k FROM evidence JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.5]) AS thr) ON sd <= thr), m AS (SELECT context, thr, round(avg(oof), 9) AS m FROM g WHERE k <= 10 GROUP BY ALL), b AS (SELECT *, max(m) OVER (PARTITION BY context) AS best FROM m) SELECT context, min(thr)::DOUBLE AS threshold FROM b WHERE m >= 0.95 * best GROUP BY 1")
def _o110(t):
    g = t.evidence().withColumn("thr", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.5))))).where("sd <= thr")
    m = top_k(g, ["context", "thr"], [F.desc("oof"), F.col("feature")], 10).groupBy("context", "thr").agg(F.round(F.avg("oof"), 9).alias("m"))
    return m.withColumn("best", F.max("m").over(Window.partitionBy("context"))).where("m >= 0.95 * best").groupBy("context").agg(F.min("thr").alias("threshold"))


@query("o102_keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _o102(t):
    return keep_first(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")
