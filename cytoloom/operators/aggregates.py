"""Aggregations and set operations: O060 to O088, O112 to O115."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import CELLS, FEATURES, PATIENTS, query

#: Features in a block of the correlation matrix.
BLOCK = 256


def quantiles(value: str, at: list[float]) -> list[Column]:
    """O064: exact, linearly interpolated quantiles."""
    return [F.percentile(value, F.lit(p)).alias(f"p{round(100 * p):02d}") for p in at]


def composition(cells: DataFrame, keys: list[str], label: str = "phenotype") -> DataFrame:
    """O070, O072, O093: counts and proportions of every label in every region and in All, by one pass of grouping sets' partial sums."""
    by = cells.groupBy(*keys, "region", label).agg(F.count(F.lit(1)).alias("n"))
    both = by.unionByName(by.groupBy(*keys, label).agg(F.sum("n").alias("n")).withColumn("region", F.lit("All")))
    return both.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "region")))


def ratios(counts: DataFrame, keys: list[str], label: str = "phenotype") -> DataFrame:
    """O071: the ratio of every ordered pair of labels; null where the denominator is 0."""
    den = counts.select(*keys, F.col(label).alias("over"), F.col("n").alias("n_over"))
    return counts.join(den, keys).where(F.col(label) != F.col("over")).withColumn("ratio", F.try_divide("n", "n_over"))


def fold_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """O076: mean, median, sample sd, quartile range and sign consistency over folds."""
    pos, neg = F.avg((F.col(value) > 0).cast("double")), F.avg((F.col(value) < 0).cast("double"))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), (q[1] - q[0]).alias("iqr"), F.min(value).alias("least"), F.max(value).alias("most"), F.greatest(pos, neg).alias("sign_consistency"), F.count(value).alias("n_folds"))


def average_rank(value: str, *part: str, desc: bool = False) -> Column:
    """Average rank of non-null values; ties share the mean of their places."""
    w = Window.partitionBy(*part, F.col(value).isNull())
    order = F.col(value).desc() if desc else F.col(value).asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(order)) + (ties - 1) / 2)


def ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inv, k = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(k) - (k - 1) / 2)[inv]


def _rho(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation of ranks; none if either is constant."""
    x, y = x - x.mean(), y - y.mean()
    s = np.sqrt((x * x).mean() * (y * y).mean())
    return float((x * y).mean() / s) if s > 0 else None


def spearman_pairs(features: DataFrame, group: list[str], min_n: int = 20, block: int = BLOCK) -> DataFrame:
    """O084, O085: Spearman correlation of every pair of features over the patients that have both, in long form; ranks are taken within each pair's patients. A patient has a feature once.

    One row a feature holds its patients and values. Features fall into blocks of about `block`, and a task compares two blocks, so a value is copied once for each block and no pair of values is a row.
    """
    v = features.where("value IS NOT NULL").groupBy(*group, "feature").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("patient_id").alias("p"), F.col("value").cast("double").alias("v")))).alias("s"))
    most = (v.groupBy(*group).agg(F.count(F.lit(1)).alias("n")) if group else v.agg(F.count(F.lit(1)).alias("n"))).agg(F.max("n")).first()[0] or 0
    n = max(1, -(-most // block))
    v = v.select(*group, "feature", F.col("s.p").alias("p"), F.col("s.v").alias("v"), F.pmod(F.xxhash64("feature"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    v = v.withColumn("lo", F.least("own", "j")).withColumn("hi", F.greatest("own", "j")).drop("j")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature", kind="stable")
        names, own = pdf["feature"].tolist(), pdf["own"].tolist()
        people = np.unique(np.concatenate(pdf["p"].tolist()))
        m = np.full((len(names), len(people)), np.nan)
        for i, (p, x) in enumerate(zip(pdf["p"], pdf["v"], strict=True)):
            m[i, np.searchsorted(people, p)] = x
        has = np.isfinite(m)
        both = has.astype(np.float32) @ has.T.astype(np.float32)
        whole = [ranks(m[i, has[i]]) for i in range(len(names))]
        out = []
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                if both[i, j] < min_n or (key[-1] != key[-2] and own[i] == own[j]):
                    continue
                if both[i, j] == len(whole[i]) == len(whole[j]):
                    r = _rho(whole[i], whole[j])
                else:
                    at = has[i] & has[j]
                    r = _rho(ranks(m[i, at]), ranks(m[j, at])) if at.any() else None
                out.append([*key[:-2], names[i], names[j], r, int(both[i, j])])
        return pd.DataFrame(out, columns=[*group, "a", "b", "rho", "n"])

    kind = features.schema["feature"].dataType.simpleString()
    fields = "".join(f"{g} {features.schema[g].dataType.simpleString()}, " for g in group)
    return v.groupBy(*group, "lo", "hi").applyInPandas(run, f"{fields}a {kind}, b {kind}, rho double, n long")


def consensus(pairs: DataFrame) -> DataFrame:
    """O086: mean correlation over cohorts, its population sd, and sign consistency."""
    pos, neg = F.count_if(F.col("rho") > 0), F.count_if(F.col("rho") < 0)
    return pairs.groupBy("a", "b").agg(F.avg("rho").alias("consensus_rho"), F.count("rho").alias("support"), F.stddev_pop("rho").alias("rho_sd"), pos.alias("n_pos"), neg.alias("n_neg"), F.try_divide(F.greatest(pos, neg), pos + neg).alias("sign_consistency"))


def combine_repeats(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """O149: mean and sample sd of each metric over the repeats of a key, and how many repeats have it."""
    return df.groupBy(*keys).agg(*[x for m in metrics for x in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_sd"), F.count(m).alias(f"{m}_n"))])


def distances(pairs: DataFrame, mode: str = "signed") -> DataFrame:
    """O176: distance of each ordered pair of features from the correlations of unordered ones (a, b, rho): signed 1 - rho, absolute 1 - |rho|, or rows: 1 - the Spearman correlation of the two rows of the correlation matrix (with itself 1). Within 0 and 2, a missing correlation counts as 0."""
    rho = F.coalesce("rho", F.lit(0.0))
    both = pairs.select("a", "b", rho.alias("rho")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), rho.alias("rho")))
    if mode == "rows":
        own = both.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("rho"))
        rows = both.unionByName(own).select(F.col("a").alias("feature"), F.col("b").alias("patient_id"), F.col("rho").alias("value"))
        return distances(spearman_pairs(rows, [], 1))
    value = F.abs("rho") if mode == "absolute" else F.col("rho")
    return both.select("a", "b", F.least(F.greatest(1 - value, F.lit(0.0)), F.lit(2.0)).alias("distance"))


def kaplan_meier(df: DataFrame, keys: list[str]) -> DataFrame:
    """O088: the product-limit estimate at each event time, and the median survival time (null if not reached)."""
    w = Window.partitionBy(*keys)
    g = df.groupBy(*keys, "time").agg(F.count(F.lit(1)).alias("n"), F.count_if("event").alias("d"))
    g = g.withColumn("at_risk", F.sum("n").over(w.orderBy(F.desc("time"))))
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(F.lit(-1e9))
    return g.withColumn("survival", F.exp(F.sum(step).over(w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))))


@query("o060_null_groups", "SELECT CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag, count(*) AS n, round(sum(l_quantity), 3) AS q FROM lineitem GROUP BY 1")
def _o060(t):
    return t("lineitem").groupBy(F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 3).alias("q"))


@query("o062_distinct_and_conditional", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high, round(avg((value > 50)::INT), 9) AS frac, bool_or(value > 99) AS any_top, bool_and(value >= 0) AS all_pos FROM events GROUP BY 1")
def _o062(t):
    hi = F.col("value") > 50
    return t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_if(hi).alias("high"), F.round(F.avg(hi.cast("double")), 9).alias("frac"), F.bool_or(F.col("value") > 99).alias("any_top"), F.bool_and(F.col("value") >= 0).alias("all_pos"))


@query("o064_quantiles", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _o064(t):
    g = t("events").groupBy("event_type").agg(*quantiles("value", [0.05, 0.25, 0.5, 0.75, 0.95]))
    return g.select("event_type", *[F.round(c, 6).alias(c) for c in g.columns[1:]])


@query("o065_first_non_null", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS first_f FROM orders GROUP BY 1")
def _o065(t):
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", v).alias("first_f"))


@query("o066_mode", "WITH c AS (SELECT l_suppkey, l_quantity AS q, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_suppkey, max(n) AS m FROM c GROUP BY 1) SELECT l_suppkey, min(q) AS mode_q FROM c JOIN m USING (l_suppkey) WHERE n = m GROUP BY 1")
def _o066(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.mode("l_quantity", deterministic=True).alias("mode_q"))


@query("o069_metric_summary", f"WITH {CELLS}, u AS (SELECT region, 'x' AS metric, x AS v FROM cells UNION ALL SELECT region, 'y', CASE WHEN y > 5 THEN y END FROM cells) SELECT region, metric, round(min(v), 6) AS least, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(max(v), 6) AS most, round(100.0 * count(v) / count(*), 6) AS pct FROM u GROUP BY ALL")
def _o069(t):
    c = t.cells().select("region", "x", F.when(F.col("y") > 5, F.col("y")).alias("y")).unpivot(["region"], ["x", "y"], "metric", "v")
    r = lambda e, n: F.round(e, 6).alias(n)
    return c.groupBy("region", "metric").agg(r(F.min("v"), "least"), r(F.avg("v"), "mean"), r(F.median("v"), "median"), r(F.max("v"), "most"), r(100.0 * F.count("v") / F.count(F.lit(1)), "pct"))


_COUNTS = f"{CELLS}, n0 AS (SELECT sample_id, region, phenotype, count(*) AS n FROM cells GROUP BY ALL), n1 AS (SELECT * FROM n0 UNION ALL SELECT sample_id, 'All', phenotype, sum(n)::BIGINT FROM n0 GROUP BY ALL)"


@query("o070_region_label_counts", f"WITH {_COUNTS} SELECT sample_id, region, phenotype, n, round(n / sum(n) OVER (PARTITION BY sample_id, region), 9) AS prop FROM n1")
def _o070(t):
    return composition(t.cells(), ["sample_id"]).select("sample_id", "region", "phenotype", "n", F.round("prop", 9).alias("prop"))


@query("o071_label_ratios", f"WITH {_COUNTS} SELECT a.sample_id, a.region, a.phenotype, b.phenotype AS over, round(a.n / nullif(b.n, 0)::DOUBLE, 9) AS ratio FROM n1 a JOIN n1 b ON a.sample_id = b.sample_id AND a.region = b.region AND a.phenotype <> b.phenotype")
def _o071(t):
    return ratios(composition(t.cells(), ["sample_id"]).drop("prop"), ["sample_id", "region"]).select("sample_id", "region", "phenotype", "over", F.round("ratio", 9).alias("ratio"))


@query("o073_pivot", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def _o073(t):
    c = t("customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1))).fillna(0)
    return c.withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("o075_core_to_patient", "SELECT o_custkey, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, max(o_totalprice) AS most, min(o_totalprice) AS least, arg_min(o_orderpriority, o_orderkey) AS priority, count(*) AS n_cores FROM orders GROUP BY 1")
def _o075(t):
    v = "o_totalprice"
    return t("orders").groupBy("o_custkey").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.max(v).alias("most"), F.min(v).alias("least"), F.min_by("o_orderpriority", "o_orderkey").alias("priority"), F.count(F.lit(1)).alias("n_cores"))


@query("o076_fold_summary", "WITH v AS (SELECT user_id, value - 50 AS v FROM events) SELECT user_id, round(avg(v), 9) AS mean, round(median(v), 6) AS median, round(stddev_samp(v), 6) AS sd, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(greatest(avg((v > 0)::INT), avg((v < 0)::INT)), 6) AS sign_consistency, count(v) AS n_folds FROM v GROUP BY 1")
def _o076(t):
    g = fold_summary(t("events").select("user_id", (F.col("value") - 50).alias("v")), ["user_id"], "v")
    return g.select("user_id", F.round("mean", 9).alias("mean"), *[F.round(c, 6).alias(c) for c in ("median", "sd", "iqr", "sign_consistency")], "n_folds")


@query("o079_enrichment", f"WITH {CELLS}, g AS (SELECT sample_id, phenotype, count(*) AS n FROM cells GROUP BY ALL) SELECT sample_id, phenotype, round((n / sum(n) OVER (PARTITION BY sample_id)) / (sum(n) OVER (PARTITION BY phenotype) / sum(n) OVER ()), 6) AS enrichment FROM g")
def _o079(t):
    g = t.cells().groupBy("sample_id", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    by = g.groupBy("phenotype").agg(F.sum("n").alias("bg"))
    total = by.agg(F.sum("bg").alias("total"))
    own = g.groupBy("sample_id").agg(F.sum("n").alias("own"))
    return g.join(own, "sample_id").join(F.broadcast(by), "phenotype").join(F.broadcast(total), F.lit(True)).select("sample_id", "phenotype", F.round((F.col("n") / F.col("own")) / (F.col("bg") / F.col("total")), 6).alias("enrichment"))


@query("o080_presence_matrix", "WITH k AS (SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders WHERE o_totalprice > 100000 UNION SELECT doc_id FROM labels) SELECT id, id IN (SELECT c_custkey FROM customer) AS has_clinical, id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS has_order, id IN (SELECT doc_id FROM labels) AS has_label FROM k")
def _o080(t):
    parts = {"clinical": t("customer").select(F.col("c_custkey").alias("id")), "order": t("orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("id")), "label": t("labels").select(F.col("doc_id").alias("id"))}
    u = None
    for n, p in parts.items():
        x = p.select("id", *[F.lit(n == m).alias(f"has_{m}") for m in parts])
        u = x if u is None else u.unionByName(x)
    return u.groupBy("id").agg(*[F.bool_or(f"has_{m}").alias(f"has_{m}") for m in parts])


@query("o081_duplicate_keys", "SELECT count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def _o081(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("count").alias("n_rows"))


@query("o083_weighted_mean", "SELECT p_partkey, round((0.45 * p_size + CASE WHEN p_partkey % 3 > 0 THEN 0.3 * p_retailprice ELSE 0 END) / (0.45 + CASE WHEN p_partkey % 3 > 0 THEN 0.3 ELSE 0 END), 6) AS score FROM part")
def _o083(t):
    price = F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice"))
    parts = [(0.45, F.col("p_size")), (0.3, price)]
    return t("part").select("p_partkey", F.round(sum((F.coalesce(w * c, F.lit(0.0)) for w, c in parts), F.lit(0.0)) / sum((F.when(c.isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0)), 6).alias("score"))


_SPEARMAN = f"{FEATURES}, ff AS (SELECT patient_id, feature, round(value, 6) AS value FROM features), j AS (SELECT a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb FROM ff a JOIN ff b ON a.patient_id = b.patient_id AND a.feature < b.feature), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM j)"


@query("o084_spearman", f"WITH {_SPEARMAN} SELECT a, b, round((covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0)), 6) AS rho, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 20")
def _o084(t):
    return spearman_pairs(t.features().withColumn("value", F.round("value", 6)), []).withColumn("rho", F.round("rho", 6))


@query("o086_cohort_consensus", f"WITH {FEATURES}, c AS (SELECT s_suppkey AS patient_id, s_nationkey % 3 AS cohort FROM supplier), ff AS (SELECT patient_id, feature, round(value, 6) AS value, cohort FROM features JOIN c USING (patient_id)), j AS (SELECT a.cohort, a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb FROM ff a JOIN ff b ON a.patient_id = b.patient_id AND a.feature < b.feature), r AS (SELECT cohort, a, b, rank() OVER (PARTITION BY cohort, a, b ORDER BY va) + (count(*) OVER (PARTITION BY cohort, a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort, a, b ORDER BY vb) + (count(*) OVER (PARTITION BY cohort, a, b, vb) - 1) / 2.0 AS rb FROM j), p AS (SELECT cohort, a, b, (covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0)) AS rho FROM r GROUP BY ALL HAVING count(*) >= 10) SELECT a, b, round(avg(rho), 6) AS consensus_rho, count(rho) AS support, round(stddev_pop(rho), 6) AS rho_sd, count(*) FILTER (WHERE rho > 0) AS n_pos, count(*) FILTER (WHERE rho < 0) AS n_neg FROM p GROUP BY ALL")
def _o086(t):
    c = t("supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_nationkey") % 3).alias("cohort"))
    f = t.features().withColumn("value", F.round("value", 6)).join(c, "patient_id")
    return consensus(spearman_pairs(f, ["cohort"], 10)).select("a", "b", F.round("consensus_rho", 6).alias("consensus_rho"), "support", F.round("rho_sd", 6).alias("rho_sd"), "n_pos", "n_neg")


@query("o088_kaplan_meier_median", f"WITH {PATIENTS}, g AS (SELECT cohort, time, count(*) AS n, count(*) FILTER (WHERE event) AS d FROM patients GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY cohort ORDER BY time DESC) AS at_risk FROM g), s AS (SELECT *, exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE -1e9 END) OVER (PARTITION BY cohort ORDER BY time)) AS s FROM r) SELECT cohort, min(time) FILTER (WHERE s <= 0.5) AS median_time, sum(d)::BIGINT AS events FROM s GROUP BY 1")
def _o088(t):
    return kaplan_meier(t.patients(), ["cohort"]).groupBy("cohort").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_time"), F.sum("d").alias("events"))


@query("o112_union_by_name", "SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _o112(t):
    return t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")).unionByName(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("o113_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)")
def _o113(t):
    s, c = t("supplier"), t("customer")
    n = lambda d, op: d.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return n(s.select("s_nationkey").union(c.select("c_nationkey")).distinct(), "union").union(n(s.select("s_suppkey").intersect(c.select("c_custkey")), "intersect")).union(n(c.select("c_custkey").exceptAll(s.select("s_suppkey")), "except"))


@query("o072_all_region", f"WITH {CELLS} SELECT sample_id, coalesce(region, 'All') AS region, phenotype, count(*) AS n FROM cells GROUP BY GROUPING SETS ((sample_id, region, phenotype), (sample_id, phenotype))")
def _o072(t):
    return composition(t.cells(), ["sample_id"]).select("sample_id", "region", "phenotype", "n")


@query("o149_repeat_combiner", "SELECT event_type, round(avg(v), 6) AS v, round(stddev_samp(v), 6) AS v_sd, count(v) AS v_n FROM (SELECT event_type, user_id % 5 AS repeat, avg(value) AS v FROM events GROUP BY ALL) GROUP BY 1")
def _o149(t):
    r = t("events").groupBy("event_type", (F.col("user_id") % 5).alias("repeat")).agg(F.avg("value").alias("v"))
    return combine_repeats(r, ["event_type"], ["v"]).withColumns({c: F.round(c, 6) for c in ("v", "v_sd")})


_RHO = f"{_SPEARMAN}, rho AS (SELECT a, b, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS rho FROM r GROUP BY ALL HAVING count(*) >= 20), bo AS (SELECT a, b, coalesce(rho, 0) AS rho FROM rho UNION ALL SELECT b, a, coalesce(rho, 0) FROM rho)"


@query("o176_distances", f"WITH {_RHO}, m AS (SELECT a AS f, b AS p, rho AS v FROM bo UNION ALL SELECT DISTINCT a, a, 1.0 FROM bo), j2 AS (SELECT x.f AS a, y.f AS b, x.v AS va, y.v AS vb FROM m x JOIN m y ON x.p = y.p AND x.f < y.f), r2 AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM j2), s AS (SELECT a, b, coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0) AS rho FROM r2 GROUP BY ALL) SELECT a, b, round(least(greatest(1 - rho, 0), 2), 6) AS distance, 'signed' AS mode FROM bo UNION ALL SELECT a, b, round(1 - abs(rho), 6), 'absolute' FROM bo UNION ALL SELECT a, b, round(least(greatest(1 - rho, 0), 2), 6), 'rows' FROM s UNION ALL SELECT b, a, round(least(greatest(1 - rho, 0), 2), 6), 'rows' FROM s")
def _o176(t):
    p, out = _o084(t), None
    for mode in ("signed", "absolute", "rows"):
        d = distances(p, mode).select("a", "b", F.round("distance", 6).alias("distance"), F.lit(mode).alias("mode"))
        out = d if out is None else out.unionByName(d)
    return out
