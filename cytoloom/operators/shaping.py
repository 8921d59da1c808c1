"""Scans of chunk folders, lookups, pivots, set operations and summaries: the operators of O002 to O152 that stand in no other module."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_p, rounded, truth
from ..plans.registry import CELLS, EVIDENCE, FEATURES, PATIENTS, query
from ..sources.scratch import new_path
from .aggregates import average_rank, consensus, spearman_pairs
from .labels import canonical
from .models import _cohorts, _fields, _over_repeats, _variants, concordant, cox, folds
from .neighbours import nearest_distances
from .spatial import neighbour_counts
from .tiles import neighbourhoods
from .windows import keep_first


def chunk_scan(spark: SparkSession, root: str, schema: str, panels: list[str] | None = None, cohorts: list[str] | None = None) -> DataFrame:
    """O005, O006: tab-separated files under root/cohort=/panel=/chunk=; the folders are columns, and panels and cohorts prune folders before any file is opened."""
    df = spark.read.option("sep", "\t").option("header", True).option("basePath", root).schema(schema).csv(root)
    for c, v in (("panel", panels), ("cohort", cohorts)):
        if v is not None:
            df = df.where(F.col(c).isin(v))
    return df


def enrich(summary: DataFrame, others: dict[str, DataFrame], keys: list[str], shared: list[str]) -> DataFrame:
    """O010: the summary's rows with each other table's columns (prefixed by its name), joined one to one by keys; shared columns are filled from the first table that has a value."""
    out = summary
    for name, o in others.items():
        one = keep_first(o, keys, [F.col(c).asc_nulls_last() for c in o.columns if c not in keys])
        out = out.join(one.withColumnsRenamed({c: f"{name}_{c}" for c in o.columns if c not in keys}), keys, "left")
    return out.withColumns({c: F.coalesce(*[F.col(x) for x in [c, *[f"{n}_{c}" for n in others]] if x in out.columns]) for c in shared})


def map_labels(c: Column, labels: dict[str, tuple[str, str]], other: str) -> Column:
    """O029, O049: struct (label, state) of a raw label by a literal map; `other` where it isn't in the map, null where it is missing or blank."""
    s = F.nullif(F.trim(c), F.lit(""))
    m = F.create_map(*[x for k, (a, b) in labels.items() for x in (F.lit(k), F.struct(F.lit(a).alias("label"), F.lit(b).alias("state")))])
    return F.when(s.isNotNull(), F.coalesce(F.try_element_at(m, s), F.struct(F.lit(other).alias("label"), F.lit(None).cast("string").alias("state"))))


def model_rows(df: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """O077: one row a feature with each model's coefficient, p and AIC; of several rows of a model the best by p, then AIC."""
    best = keep_first(df, [*keys, "model"], [F.asc_nulls_last("p"), F.asc_nulls_last("aic"), F.asc_nulls_last("coef")])
    return best.groupBy(*keys).pivot("model", models).agg(F.first("coef").alias("coef"), F.first("p").alias("p"), F.first("aic").alias("aic"))


def support(df: DataFrame, keys: list[str]) -> DataFrame:
    """O078: contexts and sources of each canonical feature; S2 with two contexts or more, else S1, and E where a lone context's metric is exceptional."""
    g = df.groupBy(*keys).agg(F.count_distinct("context").alias("n_contexts"), F.count_distinct("source").alias("n_sources"), F.max("oof").alias("best"))
    return g.withColumn("support_set", F.when(F.col("n_contexts") >= 2, "S2").when(F.col("best") >= 0.9, "E").otherwise("S1"))


def completion(actual: DataFrame, axes: dict[str, list], forbidden: Column | None = None, least: int = 1) -> DataFrame:
    """O082: every combination of the axes' values but forbidden ones, with the rows found and a status. The grid comes from short literal lists."""
    grid = actual.sparkSession.range(1).drop("id")
    for c, v in axes.items():
        grid = grid.withColumn(c, F.explode(F.array(*map(F.lit, v))))
    if forbidden is not None:
        grid = grid.where(~forbidden)
    n = actual.groupBy(*axes).agg(F.count(F.lit(1)).alias("n"))
    j = grid.join(n, list(axes), "left").fillna(0, ["n"])
    return j.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < least, "partial").otherwise("complete"))


def support_filter(pairs: DataFrame, least_pairs: int, least_share: float) -> DataFrame:
    """O087: pairs of less support count as rho 0; features with too small a share of supported partners go with their pairs."""
    p = pairs.withColumn("ok", F.col("support") >= least_pairs)
    both = p.select(F.col("a").alias("feature"), "ok").unionByName(p.select(F.col("b").alias("feature"), "ok"))
    keep = both.groupBy("feature").agg(F.avg(F.col("ok").cast("double")).alias("s")).where(F.col("s") >= least_share).select("feature")
    kept = p.join(keep.withColumnRenamed("feature", "a"), "a", "left_semi").join(keep.withColumnRenamed("feature", "b"), "b", "left_semi")
    return kept.select("a", "b", F.when(F.col("ok"), F.col("consensus_rho")).otherwise(0.0).alias("rho"))


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """O100: the integral of y over x by trapezoids; null y are left out."""
    w = Window.partitionBy(*keys).orderBy(x)
    d = df.where(F.col(y).isNotNull()).withColumn("_a", (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)))
    return d.groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def impute(df: DataFrame, numeric: list[str], other: list[str]) -> DataFrame:
    """O125: nulls of numeric columns become the median, of others the most frequent value (the least of equals). The fills are one row, from one aggregate and one count a column."""
    fills = df.agg(*[F.median(c).alias(f"_f_{c}") for c in numeric]) if numeric else df.sparkSession.range(1).drop("id")
    for c in other:
        m = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(F.min_by(c, F.struct(-F.col("_n"), c)).alias(f"_f_{c}"))
        fills = fills.join(m, F.lit(True))
    return df.join(F.broadcast(fills), F.lit(True)).select(*[F.coalesce(c, f"_f_{c}").alias(c) if c in (*numeric, *other) else F.col(c) for c in df.columns])


def flatten_interactions(df: DataFrame, keys: list[str], symmetric: bool = True) -> DataFrame:
    """O141: scores of each ordered pair of labels (mean of duplicates), the average with the reverse pair where there is one, and p of z."""
    g = df.groupBy(*keys, "a", "b").agg(F.avg("z").alias("z"))
    if symmetric:
        r = g.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"), F.col("z").alias("_r"))
        g = g.join(r, [*keys, "a", "b"], "left").withColumn("z_symmetric", (F.col("z") + F.coalesce("_r", "z")) / 2).drop("_r")
    return g.withColumn("p", normal_p(F.col("z")))


def endpoints(df: DataFrame, time_origin: str) -> DataFrame:
    """O152: response 1 or 0 from text; survival months by origin: RC, TURBT, or either (RC, else TURBT). Rows without a time over 0 or an event have no survival endpoint."""
    t = {"RC": F.col("months_RC"), "TURBT": F.col("months_TURBT"), "either": F.coalesce("months_RC", "months_TURBT")}[time_origin]
    ok = (t > 0) & F.col("event").isNotNull()
    return df.withColumns({"response_y": truth(F.col("response")).cast("int"), "time": F.when(ok, t), "event_y": F.when(ok, F.col("event").cast("int"))})


def survival_cv(df: DataFrame, keys: list[str], covariates: list[str] | None = None, penalty: float = 0.01) -> DataFrame:
    """O148, O149: out-of-fold C-index of penalised Cox models of value, of the covariates and of both, over repeats of event-stratified folds: mean and sd over repeats, and the mean gain over the clinical model. Folds with fewer than 5 events to train on are left out. One group's patients meet in a task."""
    covariates = covariates or []
    cols = ["value", *covariates, "time", "event", "fold"]

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna().sort_values(["fold", *cols[:-1]])
        t, e, f = p["time"].to_numpy(float), p["event"].to_numpy(bool), p["fold"].to_numpy()
        rows = []
        for variant, use in _variants(covariates).items():
            x, risk = p[use].to_numpy(float), np.full(len(p), np.nan)
            for k in np.unique(f):
                tr, te = f != k, f == k
                sd = x[tr].std(axis=0)
                if e[tr].sum() >= 5 and (sd > 0).all():
                    z = (x - x[tr].mean(axis=0)) / sd
                    try:
                        risk[te] = z[te] @ cox(z[tr], t[tr], e[tr], penalty * tr.sum())[0]
                    except np.linalg.LinAlgError:
                        continue
            ok = np.isfinite(risk)
            won, pairs = concordant(t[ok], e[ok], risk[ok])
            rows.append([*key, variant, won / pairs if pairs else None])
        return pd.DataFrame(rows, columns=[*keys, "repeat", "variant", "oof_c_index"])

    d = folds(df, keys, "event", "patient_id").select(*keys, "repeat", *cols)
    r = d.groupBy(*keys, "repeat").applyInPandas(lambda key, p: run(key, p[cols]), _fields(df, keys) + "repeat int, variant string, oof_c_index double")
    return _over_repeats(r, keys, ["oof_c_index"], "oof_c_index", "delta_c_index")


def _write_chunks(t) -> str:
    root = new_path(t.spark, "chunks")
    c = t.cells().select("cell_id", "x", "phenotype", F.concat(F.lit("c"), (F.col("sample_id") % 3).cast("string")).alias("cohort"), F.col("region").alias("panel"), (F.col("sample_id") % 4).alias("chunk"))
    c.write.partitionBy("cohort", "panel", "chunk").option("sep", "\t").option("header", True).csv(root)
    return root


@query("o005_chunked_scan", f"WITH {CELLS} SELECT 'c' || (sample_id % 3) AS cohort, region AS panel, phenotype, count(*) AS n, round(sum(x), 3) AS x FROM cells GROUP BY ALL")
def _o005(t):
    return chunk_scan(t.spark, _write_chunks(t), "cell_id string, x double, phenotype string, cohort string, panel string, chunk int").groupBy("cohort", "panel", "phenotype").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("x"))


@query("o006_chunk_discovery", f"WITH {CELLS} SELECT sample_id % 4 AS chunk, count(*) AS n FROM cells WHERE region = 'Tumor' AND sample_id % 3 <> 1 GROUP BY 1")
def _o006(t):
    d = chunk_scan(t.spark, _write_chunks(t), "cell_id string, x double, phenotype string, cohort string, panel string, chunk bigint", ["Tumor"], ["c0", "c2"])
    return d.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query("o010_bundle_enrich", "WITH f AS (SELECT o_custkey AS k, min(o_totalprice) AS metric FROM orders GROUP BY 1) SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, metric) AS metric, metric AS folds_metric FROM customer LEFT JOIN f ON k = c_custkey")
def _o010(t):
    s = t("customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("metric"))
    return enrich(s, {"folds": t("orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("metric"))}, ["k"], ["metric"])


@query("o026_positive_only", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ALL_NEG' WHEN p_size % 3 = 1 THEN 'A+' ELSE 'A+;B+' END AS combo FROM part")
def _o026(t):
    k = F.col("p_size") % 3
    return t("part").select("p_partkey", canonical(F.when(k == 0, "A-;B").when(k == 1, "B-; A+").otherwise("B+/A+;B+"), True).alias("combo"))


@query("o029_label_map", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'T cell' WHEN p_size % 5 = 2 THEN 'B cell' ELSE 'Other' END AS label, CASE p_size % 5 WHEN 1 THEN 'pos' WHEN 2 THEN 'neg' END AS state FROM part")
def _o029(t):
    k = F.col("p_size") % 5
    raw = F.when(k == 0, " ").when(k == 1, "CD3").when(k == 2, "CD20 ").otherwise("CD99")
    return t("part").select("p_partkey", map_labels(raw, {"CD3": ("T cell", "pos"), "CD20": ("B cell", "neg")}, "Other").alias("m")).select("p_partkey", "m.label", "m.state")


@query("o049_dimension_lookup", "SELECT s_suppkey, n_name AS nation, r_name AS cohort FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _o049(t):
    """Nation and region are fixed dimensions of 25 and 5 rows."""
    n = t("nation").join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return t("supplier").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("cohort"))


@query("o061_partial_counts", f"WITH {CELLS} SELECT region, phenotype, count(*) AS n FROM cells GROUP BY ALL")
def _o061(t):
    part = t.cells().groupBy("sample_id", "region", "phenotype").agg(F.count(F.lit(1)).alias("n"))
    return part.groupBy("region", "phenotype").agg(F.sum("n").alias("n"))


@query("o063_conditional_counts", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE event_id % 2 = 0) AS n_even, round(count(*) FILTER (WHERE value > 50) / count(*)::DOUBLE, 9) AS share_high FROM events GROUP BY 1")
def _o063(t):
    hi = F.count_if(F.col("value") > 50)
    return t("events").groupBy("event_type").agg(hi.alias("n_high"), F.count_if(F.col("event_id") % 2 == 0).alias("n_even"), F.round(hi / F.count(F.lit(1)), 9).alias("share_high"))


@query("o067_set_string", "SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS kinds FROM part GROUP BY 1")
def _o067(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("kinds"))


@query("o068_any_all", "SELECT user_id, bool_or(value > 95) AS any_high, bool_and(value > 5) AS all_over FROM events GROUP BY 1")
def _o068(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("value") > 95).alias("any_high"), F.bool_and(F.col("value") > 5).alias("all_over"))


@query("o074_unpivot", "SELECT s_suppkey, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def _o074(t):
    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot(["s_suppkey"], ["balance", "nation"], "metric", "value")


@query("o077_model_rows", "WITH m AS (SELECT o_custkey AS feature, CASE o_orderstatus WHEN 'F' THEN 'biomarker_only' ELSE 'clinical_only' END AS model, o_totalprice AS coef, (o_orderkey % 100) / 100.0::DOUBLE AS p, (o_orderkey % 7)::DOUBLE AS aic FROM orders), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY feature, model ORDER BY p, aic, coef) = 1) SELECT feature, max(coef) FILTER (WHERE model = 'biomarker_only') AS biomarker_only_coef, max(p) FILTER (WHERE model = 'biomarker_only') AS biomarker_only_p, max(aic) FILTER (WHERE model = 'biomarker_only') AS biomarker_only_aic, max(coef) FILTER (WHERE model = 'clinical_only') AS clinical_only_coef, max(p) FILTER (WHERE model = 'clinical_only') AS clinical_only_p, max(aic) FILTER (WHERE model = 'clinical_only') AS clinical_only_aic FROM b GROUP BY 1")
def _o077(t):
    m = t("orders").select(F.col("o_custkey").alias("feature"), F.when(F.col("o_orderstatus") == "F", "biomarker_only").otherwise("clinical_only").alias("model"), F.col("o_totalprice").alias("coef"), (F.col("o_orderkey") % 100 / 100).alias("p"), (F.col("o_orderkey") % 7).cast("double").alias("aic"))
    return model_rows(m, ["feature"], ["biomarker_only", "clinical_only"])


@query("o078_support", f"WITH {EVIDENCE}, g AS (SELECT feature % 150 AS f, count(DISTINCT context) AS n_contexts, count(DISTINCT source) AS n_sources, max(oof) AS best FROM evidence WHERE oof > 0.5 GROUP BY ALL) SELECT *, CASE WHEN n_contexts >= 2 THEN 'S2' WHEN best >= 0.9 THEN 'E' ELSE 'S1' END AS support_set FROM g")
def _o078(t):
    return support(t.evidence().where("oof > 0.5").withColumn("f", F.col("feature") % 150), ["f"])


@query("o082_completion", "WITH g AS (SELECT s AS status_code, p AS priority FROM (SELECT unnest(['F', 'O', 'P']) AS s), (SELECT unnest(['1-URGENT', '5-LOW', 'none']) AS p) WHERE NOT (s = 'P' AND p = '5-LOW')), n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT status_code, priority, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 100 THEN 'partial' ELSE 'complete' END AS status FROM g LEFT JOIN n ON o_orderstatus = status_code AND o_orderpriority = priority")
def _o082(t):
    a = t("orders").select(F.col("o_orderstatus").alias("status_code"), F.col("o_orderpriority").alias("priority"))
    return completion(a, {"status_code": ["F", "O", "P"], "priority": ["1-URGENT", "5-LOW", "none"]}, (F.col("status_code") == "P") & (F.col("priority") == "5-LOW"), 100)


@query("o085_pairwise_n", f"WITH {FEATURES}, f AS (SELECT patient_id, feature FROM features WHERE value > 1) SELECT a.feature AS a, b.feature AS b, count(*) AS n FROM f a JOIN f b ON a.patient_id = b.patient_id AND a.feature < b.feature GROUP BY ALL")
def _o085(t):
    f = t.features().where("value > 1")
    a, b = f.select("patient_id", F.col("feature").alias("a")), f.select("patient_id", F.col("feature").alias("b"))
    return a.join(b, "patient_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("o087_support_filter", f"WITH {FEATURES}, c AS (SELECT s_suppkey AS patient_id, s_nationkey % 2 AS cohort FROM supplier), ff AS (SELECT patient_id, feature, round(value, 6) AS value, cohort FROM features JOIN c USING (patient_id) WHERE value > 24), j AS (SELECT a.cohort, a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb FROM ff a JOIN ff b ON a.patient_id = b.patient_id AND a.feature < b.feature), r AS (SELECT cohort, a, b, rank() OVER (PARTITION BY cohort, a, b ORDER BY va) + (count(*) OVER (PARTITION BY cohort, a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort, a, b ORDER BY vb) + (count(*) OVER (PARTITION BY cohort, a, b, vb) - 1) / 2.0 AS rb FROM j), p AS (SELECT cohort, a, b, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS rho FROM r GROUP BY ALL HAVING count(*) >= 2), q AS (SELECT a, b, avg(rho) AS rho, count(rho) >= 1 AS ok FROM p GROUP BY ALL), keep AS (SELECT f FROM (SELECT a AS f, ok FROM q UNION ALL SELECT b, ok FROM q) GROUP BY f HAVING avg(ok::INT) >= 0.5) SELECT a, b, round(CASE WHEN ok THEN rho ELSE 0 END, 6) AS rho FROM q WHERE a IN (SELECT f FROM keep) AND b IN (SELECT f FROM keep)")
def _o087(t):
    s = t("supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_nationkey") % 2).alias("cohort"))
    f = t.features().where("value > 24").withColumn("value", F.round("value", 6)).join(s, "patient_id")
    return support_filter(consensus(spearman_pairs(f, ["cohort"], 2)), 1, 0.5).withColumn("rho", F.round("rho", 6))


@query("o089_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _o089(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("o092_rank_with_fill", "WITH v AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_size END AS s FROM part) SELECT p_partkey, round(coalesce(CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY p_brand, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY p_brand, s) - 1) / 2.0) / count(s) OVER (PARTITION BY p_brand) END, 0.5), 9)::DOUBLE AS r FROM v")
def _o092(t):
    v = t("part").withColumn("s", F.when(F.col("p_size") > 5, F.col("p_size")))
    r = average_rank("s", "p_brand") / F.count("s").over(Window.partitionBy("p_brand"))
    return v.select("p_partkey", F.round(F.coalesce(r, F.lit(0.5)), 9).alias("r"))


@query("o094_category_id", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS type_id FROM part")
def _o094(t):
    """Ids are made over the distinct values alone, then joined."""
    ids = t("part").select("p_type").distinct().withColumn("type_id", F.row_number().over(Window.orderBy("p_type")) - 1)
    return t("part").join(ids, "p_type").select("p_partkey", "type_id")


@query("o098_elbow", "WITH d AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS depth, (value > 60)::INT AS new FROM events), w AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY depth ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, sum(new) OVER (PARTITION BY user_id ORDER BY depth ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM d) SELECT user_id, (min(depth) FILTER (WHERE depth >= 5 AND depth + 5 <= n AND a <= 2 AND b <= 2) - 4)::INT AS elbow FROM w GROUP BY 1")
def _o098(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    d = t("events").select("user_id", F.row_number().over(w).alias("depth"), F.sum((F.col("value") > 60).cast("int")).over(w.rowsBetween(-4, 0)).alias("a"), F.sum((F.col("value") > 60).cast("int")).over(w.rowsBetween(1, 5)).alias("b"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    return d.groupBy("user_id").agg((F.min(F.when((F.col("depth") >= 5) & (F.col("depth") + 5 <= F.col("n")) & (F.col("a") <= 2) & (F.col("b") <= 2), F.col("depth"))) - 4).alias("elbow"))


@query("o100_trapezoid", "WITH d AS (SELECT p_brand, p_size, avg(p_retailprice) AS v FROM part GROUP BY ALL), l AS (SELECT p_brand, (v + lag(v) OVER w) / 2 * (p_size - lag(p_size) OVER w) AS a FROM d WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)) SELECT p_brand, round(coalesce(sum(a), 0), 4) AS area FROM l GROUP BY 1")
def _o100(t):
    d = t("part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return trapezoid(d, ["p_brand"], "p_size", "v").withColumn("area", F.round("area", 4))


@query("o101_sort_nulls_last", "SELECT p_partkey, (row_number() OVER (ORDER BY CASE WHEN p_size > 5 THEN p_size END DESC NULLS LAST, p_brand, p_partkey) <= 100) AS among_first FROM part")
def _o101(t):
    top = t("part").withColumn("s", F.when(F.col("p_size") > 5, F.col("p_size"))).orderBy(F.desc_nulls_last("s"), F.asc_nulls_last("p_brand"), "p_partkey").limit(100).select("p_partkey", F.lit(True).alias("hit"))
    return t("part").join(top, "p_partkey", "left").select("p_partkey", F.col("hit").isNotNull().alias("among_first"))


@query("o105_top_median", f"WITH {EVIDENCE}, r AS (SELECT context, oof, row_number() OVER (PARTITION BY context ORDER BY oof DESC, feature) AS k FROM evidence) SELECT context, round(median(oof) FILTER (WHERE k <= 10), 6) AS top_median FROM r GROUP BY 1")
def _o105(t):
    r = t.evidence().withColumn("k", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("oof"), "feature")))
    return r.where("k <= 10").groupBy("context").agg(F.round(F.median("oof"), 6).alias("top_median"))


@query("o111_canonical_dedup", f"WITH {EVIDENCE} SELECT context, feature % 20 AS f, feature, oof FROM evidence QUALIFY row_number() OVER (PARTITION BY context, feature % 20 ORDER BY transform, source, oof DESC, feature) = 1")
def _o111(t):
    e = t.evidence().withColumn("f", F.col("feature") % 20)
    return keep_first(e, ["context", "f"], [F.asc("transform"), F.asc("source"), F.desc("oof"), F.asc("feature")]).select("context", "f", "feature", "oof")


@query("o114_intersect", "SELECT p_size FROM part WHERE p_brand = 'Brand#11' INTERSECT SELECT p_size FROM part WHERE p_brand = 'Brand#12'")
def _o114(t):
    p = t("part")
    return p.where("p_brand = 'Brand#11'").select("p_size").intersect(p.where("p_brand = 'Brand#12'").select("p_size"))


@query("o115_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _o115(t):
    return t("customer").select("c_custkey").subtract(t("orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("o119_boolean_parse", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM customer")
def _o119(t):
    k = F.col("c_custkey") % 4
    return t("customer").select("c_custkey", truth(F.when(k == 0, " Yes").when(k == 1, "0").when(k == 2, "TRUE ").otherwise("perhaps")).alias("flag"))


@query("o125_impute", "WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS s FROM customer), m AS (SELECT median(b) AS mb FROM v), o AS (SELECT s AS ms FROM v WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) SELECT c_custkey, round(coalesce(b, mb), 6) AS b, coalesce(s, ms) AS s FROM v, m, o")
def _o125(t):
    v = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("b"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("s"))
    return impute(v, ["b"], ["s"]).withColumn("b", F.round("b", 6))


@query("o130_uid", "SELECT p_partkey, p_type || '|' || p_brand || '|' || p_size AS uid, p_brand AS grp FROM part")
def _o130(t):
    return t("part").select("p_partkey", F.concat_ws("|", "p_type", "p_brand", F.col("p_size").cast("string")).alias("uid")).withColumn("grp", F.split_part("uid", F.lit("|"), F.lit(2)))


@query("o132_months", "SELECT o_orderkey, round(date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 30.4375::DOUBLE, 6) AS months FROM orders")
def _o132(t):
    return t("orders").select("o_orderkey", F.round(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) / 30.4375, 6).alias("months"))


@query("o134_nearest_statistics", f"WITH {CELLS}, d AS (SELECT a.sample_id, a.cell_id, a.phenotype AS pa, b.phenotype AS pb, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id GROUP BY ALL) SELECT sample_id, pa, pb, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS least, round(max(d), 6) AS most, round(quantile_cont(d, 0.25), 6) AS q1, round(median(d), 6) AS med, round(quantile_cont(d, 0.75), 6) AS q3 FROM d GROUP BY ALL")
def _o134(t):
    d, q = nearest_distances(t.cells()), F.percentile("distance", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = d.groupBy("sample_id", "pa", "pb").agg(F.count("distance").alias("n"), F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("sd"), F.min("distance").alias("least"), F.max("distance").alias("most"), q[0].alias("q1"), q[1].alias("med"), q[2].alias("q3"))
    return g.withColumns({c: rounded(c, 6) for c in ("mean", "sd", "least", "most", "q1", "med", "q3")})


@query("o137_radius_graph", f"WITH {CELLS} SELECT a.sample_id, a.region, count(*) AS n_edges FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.region = b.region AND a.cell_id <> b.cell_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1 GROUP BY ALL")
def _o137(t):
    c = t.cells().withColumn("slide", F.concat_ws("/", "sample_id", "region"))
    n = neighbour_counts(neighbourhoods(c, 1.0, "slide"), "slide").groupBy("slide").agg(F.sum("n").alias("n_edges"))
    return n.select(F.split_part("slide", F.lit("/"), F.lit(1)).cast("long").alias("sample_id"), F.split_part("slide", F.lit("/"), F.lit(2)).alias("region"), "n_edges")


@query("o141_interaction_flatten", "WITH d AS (SELECT c_nationkey % 5 AS a, c_custkey % 5 AS b, c_acctbal / 5000 AS z FROM customer), g AS (SELECT a, b, avg(z) AS z FROM d GROUP BY ALL) SELECT g.a, g.b, round(g.z, 6) AS z, round((g.z + coalesce(r.z, g.z)) / 2, 6) AS z_symmetric FROM g LEFT JOIN g r ON r.a = g.b AND r.b = g.a")
def _o141(t):
    d = t("customer").select((F.col("c_nationkey") % 5).alias("a"), (F.col("c_custkey") % 5).alias("b"), (F.col("c_acctbal") / 5000).alias("z"))
    return flatten_interactions(d, []).select("a", "b", F.round("z", 6).alias("z"), F.round("z_symmetric", 6).alias("z_symmetric"))


@query("o143_sample_assembly", f"WITH {CELLS}, a AS (SELECT sample_id, avg(x) AS tumor FROM cells WHERE region = 'Tumor' AND sample_id % 4 <> 0 GROUP BY 1), b AS (SELECT sample_id, avg(x) AS stroma FROM cells WHERE region = 'Stroma' AND sample_id % 5 <> 0 GROUP BY 1) SELECT sample_id, round(tumor, 6) AS tumor, round(stroma, 6) AS stroma FROM a FULL JOIN b USING (sample_id)")
def _o143(t):
    part = lambda r, k, n: t.cells().where((F.col("region") == r) & (F.col("sample_id") % k != 0)).groupBy("sample_id").agg(F.round(F.avg("x"), 6).alias(n))
    return reduce(lambda x, y: x.join(y, "sample_id", "full"), [part("Tumor", 4, "tumor"), part("Stroma", 5, "stroma")])


@query("o148_survival_cv")
def _o148(t):
    return survival_cv(_cohorts(t), ["cohort"], ["nation"])


@query("o152_endpoints", f"WITH {PATIENTS} SELECT patient_id, CASE WHEN event THEN 1 ELSE 0 END::INT AS response_y, CASE WHEN (CASE WHEN patient_id % 3 = 0 THEN time * 2 ELSE time END) > 0 THEN CASE WHEN patient_id % 3 = 0 THEN time * 2 ELSE time END END AS time, CASE WHEN time > 0 THEN event::INT END AS event_y FROM patients")
def _o152(t):
    p = t.patients().select("patient_id", F.when(F.col("event"), "yes").otherwise("No").alias("response"), F.when(F.col("patient_id") % 3 != 0, F.col("time")).alias("months_RC"), (F.col("time") * 2).alias("months_TURBT"), "event")
    return endpoints(p, "either").select("patient_id", "response_y", "time", "event_y")
