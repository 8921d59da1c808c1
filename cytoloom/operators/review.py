"""Clinical, label, metric and alignment tables of the reports: O188, O192, O196, O198."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import CELLS, EVIDENCE, PATIENTS, query
from .aggregates import kaplan_meier

# Words for yes and no, and the quantiles and rules of the review tables.
YES = ["1", "true", "yes", "y", "pos", "positive", "event", "responder", "response", "cr", "pr"]
NO = ["0", "false", "no", "n", "neg", "negative", "none", "nonresponder", "non-responder", "stable", "sd", "pd"]
QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90, "p95": 0.95}
NO_NAME = ["", "nan", "None", "<NA>"]


def share(hits: Column, of: Column, digits: int = 1) -> Column:
    """O131: n (%) as text; without a denominator the number alone."""
    pct = F.format_string(f"%.{digits}f", F.round(100.0 * hits / of, digits))
    return F.when(of > 0, F.concat(hits.cast("string"), F.lit(" ("), pct, F.lit("%)"))).otherwise(hits.cast("string"))


def spread(value: str, digits: int = 1) -> Column:
    """O131: median (quartiles) as text; `NA` without values."""
    q = [F.format_string(f"%.{digits}f", F.round(F.percentile(value, F.lit(p)), digits)) for p in (0.5, 0.25, 0.75)]
    return F.when(F.count(value) > 0, F.concat(q[0], F.lit(" ("), q[1], F.lit("-"), q[2], F.lit(")"))).otherwise("NA")


def binary(c: Column) -> Column:
    """O188: 1 or 0 from words and numbers; null where it is neither."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(YES), 1).when(s.isin(NO), 0).otherwise(s.try_cast("double").cast("int"))


def stage_from(c: Column, least: int) -> Column:
    """O188: whether the greatest number in a stage is `least` or more; null without a number."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(numbers) > 0, (F.array_max(F.transform(numbers, lambda x: x.cast("int"))) >= least).cast("int"))


def stage_zero(c: Column) -> Column:
    """O188: whether a T stage is 0."""
    s = F.upper(F.trim(c))
    return F.when(s.rlike(r"T\s*0") | s.isin("0", "PT0", "YPT0"), 1).when(s.rlike(r"T\s*[1-9]"), 0).otherwise((s.try_cast("double") == 0).cast("int"))


def node_positive(c: Column) -> Column:
    """O188: whether an N stage is over 0."""
    s = F.upper(F.trim(c))
    return F.when(s.rlike(r"N\s*0") | (s == "0"), 0).when(s.rlike(r"N\s*[1-9]"), 1).otherwise((s.try_cast("double") > 0).cast("int"))


def clinical_summary(patients: DataFrame, cohort: str, medians: list[str], shares: list[str], survival: dict[str, tuple[str, str]]) -> DataFrame:
    """O188: a row a cohort: n; median (quartiles) of numbers; n (%) of 0/1 columns among those not null, with their number; and for each survival (time, event): evaluable patients, events, time, and the Kaplan-Meier median (`NR` if not reached). patients: one row each."""
    one = patients.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n"), *(spread(c).alias(c) for c in medians),
        *(x for c in shares for x in (F.count(c).alias(f"{c}_evaluable"), share(F.coalesce(F.sum(c), F.lit(0)).cast("long"), F.count(c)).alias(c))),
    )
    for name, (time, event) in survival.items():
        d = patients.select(cohort, F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event")).where("time IS NOT NULL AND event IS NOT NULL")
        figures = d.groupBy(cohort).agg(F.count(F.lit(1)).alias(f"{name}_evaluable"), share(F.sum("event").cast("long"), F.count(F.lit(1))).alias(f"{name}_events"), spread("time").alias(f"{name}_time"))
        km = kaplan_meier(d.where("time >= 0").withColumn("event", F.col("event") == 1), [cohort]).groupBy(cohort).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("time"))).alias("m"))
        km = km.select(cohort, F.when(F.col("m").isNull(), "NR").otherwise(F.format_string("%.1f", F.round("m", 1))).alias(f"{name}_median"))
        one = one.join(figures, cohort, "left").join(km, cohort, "left")
    return one


def label_summary(cells: DataFrame, by: list[str], unit: str, label: str) -> DataFrame:
    """O192: of each label: cells, units that have it and their share, and its median, mean and greatest share of the cells of those units."""
    n = F.count(F.lit(1))
    c = cells.groupBy(*by, unit, label).agg(n.alias("n")).withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy(*by, unit)))
    units = c.groupBy(*by).agg(F.count_distinct(unit).alias("units"))
    s = c.groupBy(*by, label).agg(F.sum("n").alias("n_cells"), n.alias("n_units"), F.median("part").alias("median_part"), F.avg("part").alias("mean_part"), F.max("part").alias("most_part"))
    return s.join(units, by).withColumn("share_of_units", F.col("n_units") / F.col("units")).drop("units")


def label_by_cohort(cells: DataFrame, by: list[str], unit: str, label: str) -> DataFrame:
    """O192: of each label in each cohort: cells, their share, and cells for each of the cohort's units."""
    n = cells.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_cells"))
    units = cells.groupBy(*by).agg(F.count_distinct(unit).alias("n_units"))
    return n.join(units, by).withColumn("part", F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(*by))).withColumn("per_unit", F.col("n_cells") / F.col("n_units"))


def metric_summary(selected: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """O196: of each metric: rows, values, missing share, least, mean, quantiles and greatest."""
    long = selected.select(*by, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(by, metrics, "metric", "x").withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    q = F.percentile("x", F.array(*map(F.lit, QUANTILES.values())))
    s = long.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_available"), F.min("x").alias("least"), F.avg("x").alias("mean"), q.alias("q"), F.max("x").alias("most"))
    return s.select(*by, "metric", "n", "n_available", (1 - F.col("n_available") / F.col("n")).alias("missing"), "least", "mean", *(F.col("q")[i].alias(k) for i, k in enumerate(QUANTILES)), "most")


def threshold_counts(selected: DataFrame, by: list[str], rules: list[tuple[str, str, float]]) -> DataFrame:
    """O196: of each rule (metric, `>=` or `<=`, threshold): values and those that pass, of available ones and of all. All rules in one aggregate."""
    passes = lambda m, op, x: F.count_if(F.col(m) >= x if op == ">=" else F.col(m) <= x)
    one = selected.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.struct(F.count(m).alias("n_available"), passes(m, op, x).alias("n_passing")).alias(f"r{i}") for i, (m, op, x) in enumerate(rules)))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(op).alias("operator"), F.lit(float(x)).alias("threshold"), F.col(f"r{i}.n_available").alias("n_available"), F.col(f"r{i}.n_passing").alias("n_passing")) for i, (m, op, x) in enumerate(rules)))).alias("r")
    return one.select(*by, "n", each).select(*by, "r.*", "n", (F.col("r.n_passing") / F.greatest("r.n_available", F.lit(1))).alias("of_available"), (F.col("r.n_passing") / F.col("n")).alias("of_all"))


def alignment(base: DataFrame, others: dict[str, DataFrame], by: list[str], coord: str) -> DataFrame:
    """O198: for each group of the base table its different coordinates and, as n (%), how many of them each other table has, and how many all have. Groups without a name are `NA`; blanks around coordinates don't count, and those without a name are left out of the other tables."""
    named = lambda c: F.when(F.trim(c.cast("string")).isin(NO_NAME) | c.isNull(), "NA").otherwise(F.trim(c.cast("string")))
    b = base.select(*(named(F.col(c)).alias(c) for c in by), named(F.col(coord)).alias("coord")).distinct()
    for name, t in others.items():
        has = t.select(F.trim(F.col(coord).cast("string")).alias("coord")).where("coord <> ''").distinct().withColumn(name, F.lit(1))
        b = b.join(has, "coord", "left")
    n, every = F.count(F.lit(1)), reduce(lambda p, q: p & q, (F.col(x).isNotNull() for x in others))
    return b.groupBy(*by).agg(n.alias("n"), *(share(F.count(x), n).alias(x) for x in others), share(F.count_if(every), n).alias("all_tables"))


_PCT = "{h} || CASE WHEN {n} > 0 THEN ' (' || printf('%.1f', round(100.0::DOUBLE * {h} / {n}, 1)) || '%)' ELSE '' END"
_IQR = "CASE WHEN count({x}) > 0 THEN printf('%.1f', round(median({x})::DOUBLE, 1)) || ' (' || printf('%.1f', round(quantile_cont({x}, 0.25)::DOUBLE, 1)) || '-' || printf('%.1f', round(quantile_cont({x}, 0.75)::DOUBLE, 1)) || ')' ELSE 'NA' END"
_STAGES = {"ct": ["T1", "cT2", "pT3a", "T4", "x", None], "pt": ["pT0", "T1", "ypT0", "0", "T 2", None], "pn": ["N0", "N1", "pN2", "0", "1", "NX"], "response": ["CR", "sd", "yes", "0", "1.0", "?"]}
_MEANS = {"ct": [0, 0, 1, 1, None, None], "pt": [1, 0, 1, 1, 0, None], "pn": [0, 1, 1, 0, 1, None], "response": [1, 0, 1, 0, 1, None]}
_PARSED = ", ".join(f"[{', '.join('NULL' if x is None else str(x) for x in v)}][(patient_id + {i}) % 6 + 1] AS {c}" for i, (c, v) in enumerate(_MEANS.items()))


@query("o188_clinical_summary", f"WITH {PATIENTS}, p AS (SELECT *, {_PARSED} FROM patients), g AS (SELECT cohort, time, count(*) AS n, count(*) FILTER (WHERE event) AS d FROM p WHERE time >= 0 GROUP BY ALL), k AS (SELECT cohort, time, exp(sum(CASE WHEN d < r THEN ln(1 - d / r::DOUBLE) ELSE -1e9 END) OVER (PARTITION BY cohort ORDER BY time)) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY cohort ORDER BY time DESC) AS r FROM g)), m AS (SELECT cohort, coalesce(printf('%.1f', min(time) FILTER (WHERE s <= 0.5 + 1e-12)), 'NR') AS os_median FROM k GROUP BY 1) SELECT cohort, count(*) AS n, {_IQR.format(x='marker')} AS marker, {', '.join(f'count({c}) AS {c}_evaluable, ' + _PCT.format(h=f'coalesce(sum({c}), 0)', n=f'count({c})') + f' AS {c}' for c in _MEANS)}, count(*) FILTER (WHERE time IS NOT NULL) AS os_evaluable, {_PCT.format(h='count(*) FILTER (WHERE event)', n='count(*)')} AS os_events, {_IQR.format(x='time')} AS os_time, any_value(os_median) AS os_median FROM p JOIN m USING (cohort) GROUP BY 1")
def _o188_summary(t):
    p = t.patients()
    text = lambda i, c: F.array(*map(F.lit, _STAGES[c]))[((F.col("patient_id") + i) % 6).cast("int")]
    read = {"ct": lambda x: stage_from(x, 3), "pt": stage_zero, "pn": node_positive, "response": binary}
    p = p.withColumns({c: read[c](text(i, c)) for i, c in enumerate(_STAGES)})
    return clinical_summary(p, "cohort", ["marker"], list(_STAGES), {"os": ("time", "event")})


@query("o192_label_summary", f"WITH {CELLS}, c AS (SELECT region, sample_id, phenotype, count(*) AS n FROM cells GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY region, sample_id) AS part FROM c), u AS (SELECT region, count(DISTINCT sample_id) AS units FROM c GROUP BY 1) SELECT region, phenotype, sum(n)::BIGINT AS n_cells, count(*) AS n_units, round(median(part), 9) AS median_part, round(avg(part), 9) AS mean_part, round(max(part), 9) AS most_part, round(count(*) / any_value(units), 9) AS share_of_units FROM f JOIN u USING (region) GROUP BY ALL")
def _o192_summary(t):
    return label_summary(t.cells(), ["region"], "sample_id", "phenotype").withColumns({c: F.round(c, 9) for c in ("median_part", "mean_part", "most_part", "share_of_units")})


@query("o192_label_by_cohort", f"WITH {CELLS}, c AS (SELECT s_nationkey AS cohort, region, phenotype, sample_id FROM cells JOIN supplier ON s_suppkey = sample_id), u AS (SELECT cohort, region, count(DISTINCT sample_id) AS n_units FROM c GROUP BY ALL), n AS (SELECT cohort, region, phenotype, count(*) AS n_cells FROM c GROUP BY ALL) SELECT cohort, region, phenotype, n_cells, n_units, round(n_cells / sum(n_cells) OVER (PARTITION BY cohort, region), 9) AS part, round(n_cells / n_units, 9) AS per_unit FROM n JOIN u USING (cohort, region)")
def _o192_cohort(t):
    s = t("supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("cohort"))
    return label_by_cohort(t.cells().join(s, "sample_id"), ["cohort", "region"], "sample_id", "phenotype").withColumns({c: F.round(c, 9) for c in ("part", "per_unit")})


_RULES = [("oof", ">=", 0.55), ("oof", ">=", 0.6), ("oof", ">=", 0.65), ("sd", "<=", 0.05), ("sd", "<=", 0.1), ("sd", "<=", 0.15)]


@query("o196_metric_summary", f"WITH {EVIDENCE}, l AS (SELECT context, metric, x FROM (SELECT context, CASE WHEN transform > 0 THEN oof END AS oof, sd FROM evidence) UNPIVOT INCLUDE NULLS (x FOR metric IN (oof, sd))) SELECT context, metric, count(*) AS n, count(x) AS n_available, round(1 - count(x) / count(*), 9) AS missing, round(min(x), 9) AS least, round(avg(x), 9) AS mean, {', '.join(f'round(quantile_cont(x, {p}), 9) AS {k}' for k, p in QUANTILES.items())}, round(max(x), 9) AS most FROM l GROUP BY ALL")
def _o196_metrics(t):
    e = t.evidence().select("context", F.when(F.col("transform") > 0, F.col("oof")).alias("oof"), "sd")
    m = metric_summary(e, ["context"], ["oof", "sd"])
    return m.select("context", "metric", "n", "n_available", *(F.round(c, 9).alias(c) for c in m.columns[4:]))


@query("o196_threshold_counts", f"WITH {EVIDENCE}, r AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _RULES)}) v(metric, operator, threshold)), e AS (SELECT context, CASE WHEN transform > 0 THEN oof END AS oof, sd FROM evidence), x AS (SELECT context, metric, operator, threshold::DOUBLE AS threshold, CASE metric WHEN 'oof' THEN oof ELSE sd END::DOUBLE AS x FROM e, r), n AS (SELECT context, metric, operator, threshold, count(*) AS n, count(x) AS n_available, count(*) FILTER (WHERE CASE operator WHEN '>=' THEN x >= threshold ELSE x <= threshold END) AS n_passing FROM x GROUP BY ALL) SELECT *, round(n_passing / greatest(n_available, 1), 9) AS of_available, round(n_passing / n, 9) AS of_all FROM n")
def _o196_thresholds(t):
    e = t.evidence().select("context", F.when(F.col("transform") > 0, F.col("oof")).alias("oof"), "sd")
    return threshold_counts(e, ["context"], _RULES).withColumns({c: F.round(c, 9) for c in ("of_available", "of_all")})


@query("o198_alignment_tables", f"WITH b AS (SELECT DISTINCT c_mktsegment AS panel, CASE WHEN c_nationkey = 3 THEN 'NA' ELSE c_nationkey::VARCHAR END AS cohort, c_custkey::VARCHAR AS coord FROM customer), m AS (SELECT DISTINCT o_custkey::VARCHAR AS coord FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT DISTINCT o_custkey::VARCHAR AS coord FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT panel, cohort, count(*) AS n, count(m.coord) AS a, count(q.coord) AS b, count(*) FILTER (WHERE m.coord IS NOT NULL AND q.coord IS NOT NULL) AS c FROM b LEFT JOIN m USING (coord) LEFT JOIN q USING (coord) GROUP BY ALL) SELECT panel, cohort, n, {_PCT.format(h='a', n='n')} AS meta, {_PCT.format(h='b', n='n')} AS qc, {_PCT.format(h='c', n='n')} AS all_tables FROM h")
def _o198_tables(t):
    c = t("customer").select(F.col("c_mktsegment").alias("panel"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey").cast("string")).otherwise(" nan ").alias("cohort"), F.concat(F.lit(" "), F.col("c_custkey").cast("string")).alias("coord"))
    o = t("orders").withColumn("coord", F.col("o_custkey"))
    return alignment(c, {"meta": o.where("o_orderstatus = 'F'"), "qc": o.where("o_orderpriority = '1-URGENT'")}, ["panel", "cohort"], "coord")
