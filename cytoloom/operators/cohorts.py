"""Cohort, clinical and sample tables: O003, O012, O013, O036 to O046, O154 to O162, O189 to O196."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import number, stage
from ..plans.registry import CELLS, EVIDENCE, query
from ..sources.scratch import new_path
from .joins import join_validated
from .windows import keep_first


def section_rows(spark: SparkSession, root: str, panel: str, batch: int) -> DataFrame:
    """O003: rows of the parquet files under root whose path names the panel and the batch (Batch1, Batch 1 or Batch_1); region_id is the file's folder. The condition on the path prunes files before they are read."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "%20", " ")
    df = spark.read.option("recursiveFileLookup", True).parquet(root)
    named = path.rlike(rf"(?i)/{panel}/") & path.rlike(rf"(?i)/batch[ _]?{batch}/")
    return df.where(named).withColumn("region_id", F.element_at(F.split(path, "/"), -2))


def tissue_inventory(areas: DataFrame, keys: list[str], regions: list[str], metrics: list[str]) -> DataFrame:
    """O012: long (keys, region, metrics) to one row a sample with <region>_<metric>; has_tissue where any is over 0."""
    w = areas.groupBy(*keys).pivot("region", regions).agg(*[F.max(m).alias(m) for m in metrics])
    if len(metrics) == 1:
        w = w.withColumnsRenamed({r: f"{r}_{metrics[0]}" for r in regions})
    return w.withColumn("has_tissue", F.coalesce(F.greatest(F.lit(0.0), *[F.col(f"{r}_{m}") for r in regions for m in metrics]) > 0, F.lit(False)))


def reviews(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """O013: the first row of each key, those with a label before those without."""
    return keep_first(df, keys, [F.col(label).isNull().asc(), F.col(order).asc_nulls_last()])


def sample_type(c: Column) -> Column:
    """O036: TURBT or RC from free text; null for anything else."""
    s = F.upper(F.trim(c))
    return F.when(s.startswith("TUR"), "TURBT").when(s.startswith("RC") | s.contains("CYSTECTOMY"), "RC")


def patient_subset(df: DataFrame, subset: str, cohorts: list[str], survival: bool, column: str = "adjuvant") -> DataFrame:
    """O036: all, or those with (adjuvant_yes) or without (adjuvant_no) adjuvant therapy; the latter two only for the stated cohorts and survival endpoints, otherwise no rows."""
    if subset == "all":
        return df
    return df.where(F.col("cohort").isin(cohorts) & F.lit(survival) & (F.col(column) == F.lit(subset == "adjuvant_yes")))


def project_filters(df: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """O040: rows whose context columns are among the values asked for; an empty list or a missing column asks nothing."""
    conds = [F.col(c).isin(v) for c, v in wanted.items() if v and c in df.columns]
    return df.where(reduce(Column.__and__, conds)) if conds else df


def numeric_like(df: DataFrame, reserved: list[str]) -> DataFrame:
    """O042: (name, n_numbers) of the non-reserved columns that are numbers, or texts of which a value is one; one aggregate over the columns, a row for each."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in reserved}
    real = lambda k: k in ("double", "float", "bigint", "int", "smallint", "tinyint") or k.startswith("decimal")
    numbers = lambda c, k: F.count(F.col(f"`{c}`") if real(k) else number(F.col(f"`{c}`")))
    some = [F.struct(F.lit(c).alias("name"), F.lit(real(k)).alias("typed"), numbers(c, k).alias("n_numbers")) for c, k in kinds.items() if real(k) or k == "string"]
    one = df.agg(*(x.alias(f"_{i}") for i, x in enumerate(some)))
    return one.select(F.inline(F.array(*(F.col(f"_{i}") for i in range(len(some)))))).where("typed OR n_numbers > 0").drop("typed")


def covariates(df: DataFrame, names: list[str], most_missing: float = 0.5) -> DataFrame:
    """O154: share missing and levels of each covariate, and whether it is used, in one pass."""
    n = F.count(F.lit(1))
    a = df.agg(*[F.struct(F.lit(c).alias("covariate"), F.try_divide(F.count_if(F.col(c).isNull()), n).alias("missing"), F.count_distinct(F.col(c)).alias("levels")).alias(f"_{i}") for i, c in enumerate(names)])
    r = a.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(names))])))
    return r.withColumn("used", F.coalesce((F.col("missing") <= most_missing) & (F.col("levels") > 1), F.lit(False)))


def variable_audit(df: DataFrame, candidates: dict[str, list[str]], cohort: str) -> DataFrame:
    """O155: for each cohort and variable the candidate columns in order, their values, levels and share that parses as numbers; usable with 3 values and 2 levels; numeric if 80 % parse; chosen is the first usable one. One aggregate, whatever the number of candidates."""
    every = [(v, i, c) for v, cs in candidates.items() for i, c in enumerate(cs) if c in df.columns]
    one = lambda v, i, c, x: F.struct(F.lit(v).alias("variable"), F.lit(i).alias("place"), F.lit(c).alias("column"), F.count(x).alias("n"), F.count_distinct(x).alias("levels"), F.count(number(x)).alias("n_numbers"))
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    a = df.groupBy(cohort).agg(*[one(v, i, c, blank(c)).alias(f"_{k}") for k, (v, i, c) in enumerate(every)])
    r = a.select(cohort, F.inline(F.array(*[F.col(f"_{k}") for k in range(len(every))])))
    r = r.withColumn("usable", (F.col("n") >= 3) & (F.col("levels") > 1)).withColumn("is_numeric", F.col("n_numbers") >= 0.8 * F.col("n"))
    first = F.min(F.when(F.col("usable"), F.col("place"))).over(Window.partitionBy(cohort, "variable"))
    return r.withColumn("chosen", F.coalesce(F.col("place") == first, F.lit(False)))


def patient_id(df: DataFrame, candidates: list[str]) -> Column:
    """O156: the first candidate column with a value that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in candidates if c in df.columns], F.lit(None).cast("string"))


def override(core: DataFrame, harmonised: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """O156: columns of the harmonised table take the place of the core table's, but for those in keep."""
    gone = [c for c in core.columns if c in harmonised.columns and c != key and c not in keep]
    return core.drop(*gone).join(harmonised.drop(*keep), key, "left")


def encode_clinical(df: DataFrame) -> DataFrame:
    """O157: age as a number, sex 1 for male and 0 for female, the ordinal of each stage."""
    s = F.upper(F.substring(F.trim("sex"), 1, 1))
    return df.withColumns({"age": number(F.col("age").cast("string")), "sex": F.when(s == "M", 1).when(s == "F", 0)} | {c: stage(F.col(c)) for c in ("cN", "cT", "pN", "pT") if c in df.columns})


def two_scale_scores(values: DataFrame, membership: DataFrame, reference: str) -> DataFrame:
    """O158: program scores of both sample types on the reference type's scale (for differences) and on each type's own. The parameters, one row a feature and type, are joined to the facts."""
    v = values.where("value IS NOT NULL").join(membership, "feature")
    p = v.groupBy("feature", "sample_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    own = p.select("feature", "sample_type", "m", "s", F.lit("internal").alias("mode"))
    types = values.select("sample_type").distinct()
    ref = p.where(F.col("sample_type") == reference).drop("sample_type").join(F.broadcast(types), F.lit(True)).select("feature", "sample_type", "m", "s", F.lit("reference").alias("mode"))
    z = v.join(own.unionByName(ref), ["feature", "sample_type"]).withColumn("z", F.try_divide(F.col("value") - F.col("m"), F.nullif("s", F.lit(0.0))))
    return z.groupBy("patient_id", "sample_type", "program", "mode").agg(F.avg("z").alias("score"), F.count("z").alias("n_present"))


def favourable(coef: str, survival: Column) -> Column:
    """O161: an effect's size in the favourable direction: for survival a higher hazard is unfavourable."""
    return F.when(survival, -F.col(coef)).otherwise(F.col(coef))


def recurrence(df: DataFrame, keys: list[str]) -> DataFrame:
    """O162: over contexts, counts of favourable, unfavourable and nominal effects, and medians."""
    up, down, p = F.col("favourable") > 0, F.col("favourable") < 0, F.col("p") < 0.05
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_contexts"), F.count_if(up).alias("n_favourable"), F.count_if(down).alias("n_unfavourable"), F.count_if(up & p).alias("nominal_favourable"), F.count_if(up & (F.col("q") < 0.1)).alias("q10_favourable"), F.median("favourable").alias("median_favourable"))


def concordant(discovery: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """O162: the discovery cohorts' median effect beside the held-out cohort's, and whether the signs agree."""
    d = discovery.groupBy(*keys).agg(F.median("favourable").alias("discovery"))
    h = held_out.groupBy(*keys).agg(F.median("favourable").alias("held_out"))
    return d.join(h, keys).withColumn("same_direction", F.signum("discovery") == F.signum("held_out"))


def unit_summary(units: DataFrame, by: str) -> DataFrame:
    """O189: panel units, physical units, those ready for analysis, and patients with both sample types."""
    per = units.groupBy(by, "patient_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("u"), F.count_if("ready").alias("r"), (F.array_size(F.collect_set("sample_type")) > 1).alias("matched"))
    return per.groupBy(by).agg(F.sum("n").alias("n_panel_units"), F.sum("u").alias("n_units"), F.sum("r").alias("n_ready"), F.count("patient_id").alias("n_patients"), F.count_if(F.col("matched") & F.col("patient_id").isNotNull()).alias("n_matched"))


def presence_summary(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """O193: rows, and the number and share that have each thing, by group."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in flags], *[(F.count_if(c) / n).alias(f"share_{c}") for c in flags])


def sample_qc(cells: DataFrame, tissue: DataFrame, key: str, regions: list[str]) -> DataFrame:
    """O194: every sample of either table, whether each has it, cells in all and by region."""
    c = cells.groupBy(key).pivot("region", regions).count().withColumnsRenamed({r: f"n_{r}" for r in regions}).withColumn("has_cells", F.lit(True))
    j = c.join(tissue.select(key).distinct().withColumn("has_tissue", F.lit(True)), key, "full")
    ns = [f"n_{r}" for r in regions]
    return j.fillna(0, ns).fillna(False, ["has_cells", "has_tissue"]).withColumn("n_cells", reduce(Column.__add__, map(F.col, ns)))


def metric_summary(df: DataFrame, by: list[str], metrics: list[str], least: dict[str, list[float]]) -> DataFrame:
    """O196: the distribution of each metric by group, and how many reach each of its thresholds."""
    long = df.unpivot(by, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "v")
    cuts = F.create_map(*[x for m in metrics for x in (F.lit(m), F.array(*[F.lit(float(t)) for t in least.get(m, [])]).cast("array<double>"))])
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    n = max(len(least.get(m, [])) for m in metrics)
    d = long.withColumn("cuts", cuts[F.col("metric")])
    return d.groupBy(*by, "metric").agg(F.count("v").alias("n"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), *[F.count_if(F.col("v") >= F.get("cuts", F.lit(i))).alias(f"n_reach_{i + 1}") for i in range(n)])


@query("o003_section_discovery", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'Batch1' WHEN 1 THEN 'Batch 1' ELSE 'Batch_1' END AS region_id FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 <> 0")
def _o003(t):
    root, s = new_path(t.spark, "sections"), t("supplier").select("s_suppkey", "s_nationkey")
    for panel, odd in (("P1", 0), ("P2", 1)):
        for k, batch in enumerate(("Batch1", "Batch 1", "Batch_1")):
            s.where(f"s_suppkey % 2 = {odd} AND s_suppkey % 5 <> 0 AND s_nationkey % 3 = {k}").coalesce(1).write.parquet(f"{root}/{panel}/{batch}")
        s.where(f"s_suppkey % 2 = {odd} AND s_suppkey % 5 = 0").coalesce(1).write.parquet(f"{root}/{panel}/Batch12")
    return section_rows(t.spark, root, "P1", 1).select("s_suppkey", "region_id")


@query("o012_tissue_inventory", f"WITH {CELLS}, a AS (SELECT sample_id, region, count(*)::DOUBLE AS n, round(sum(x), 3) AS area FROM cells WHERE sample_id % 4 <> 0 OR region = 'Tumor' GROUP BY ALL) SELECT sample_id, max(n) FILTER (WHERE region = 'Tumor') AS \"Tumor_n\", max(area) FILTER (WHERE region = 'Tumor') AS \"Tumor_area\", max(n) FILTER (WHERE region = 'Stroma') AS \"Stroma_n\", max(area) FILTER (WHERE region = 'Stroma') AS \"Stroma_area\", true AS has_tissue FROM a GROUP BY 1")
def _o012(t):
    a = t.cells().where("sample_id % 4 <> 0 OR region = 'Tumor'").groupBy("sample_id", "region").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("x"), 3).alias("area"))
    return tissue_inventory(a, ["sample_id"], ["Tumor", "Stroma"], ["n", "area"])


@query("o013_review_loader", "SELECT user_id, event_type, event_id, CASE WHEN value > 80 THEN 'bad' WHEN value > 40 THEN 'ok' END AS label FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 40 THEN 0 ELSE 1 END, event_id) = 1")
def _o013(t):
    e = t("events").select("user_id", "event_type", "event_id", F.when(F.col("value") > 80, "bad").when(F.col("value") > 40, "ok").alias("label"))
    return reviews(e, ["user_id", "event_type"], "label", "event_id")


@query("o036_sample_subset", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'TURBT' WHEN 'O' THEN 'RC' END AS sample_type FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice > 150000 AND o_orderstatus IN ('F', 'O')")
def _o036(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("cohort"), (F.col("o_totalprice") > 150000).alias("adjuvant"), sample_type(F.when(F.col("o_orderstatus") == "F", " turbt ").when(F.col("o_orderstatus") == "O", "Radical cystectomy").otherwise("biopsy")).alias("sample_type"))
    return patient_subset(o, "adjuvant_yes", ["BUILDING", "MACHINERY"], True).where("sample_type IS NOT NULL").select("o_orderkey", "sample_type")


@query("o040_project_filters", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_size IN (1, 2, 3, 4, 5, 10, 20)")
def _o040(t):
    return project_filters(t("part"), {"p_brand": ["Brand#11", "Brand#12", "Brand#23"], "p_size": [1, 2, 3, 4, 5, 10, 20], "p_type": [], "absent": ["x"]}).select("p_partkey")


@query("o042_numeric_like", "SELECT 's_acctbal' AS name, count(s_acctbal) AS n_numbers FROM supplier UNION ALL SELECT 's_nationkey', count(s_nationkey) FROM supplier UNION ALL SELECT 'mixed', count(*) FILTER (WHERE s_suppkey % 3 = 0) FROM supplier")
def _o042(t):
    s = t("supplier").withColumn("mixed", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey").cast("string")).otherwise("n/a")).withColumn("words", F.lit("n/a")).select("s_suppkey", "s_nationkey", "s_acctbal", "mixed", "words")
    return numeric_like(s, ["s_suppkey"])


@query("o046_left_join_suffix", "SELECT o_orderkey, o_totalprice AS amount, c_acctbal AS amount_clinical FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey")
def _o046(t):
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"), F.col("o_totalprice").alias("amount"))
    c = t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("patient_id"), F.col("c_acctbal").alias("amount"))
    return join_validated(o, c, ["patient_id"], suffix="_clinical").drop("patient_id")


_COVARIATES = "SELECT c_custkey, CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE c_acctbal END AS sparse, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS one FROM customer"


@query("o154_covariate_choice", f"WITH c AS ({_COVARIATES}), a AS (" + " UNION ALL ".join(f"SELECT '{x}' AS covariate, round((count(*) - count({x})) / count(*)::DOUBLE, 9) AS missing, count(DISTINCT {x}) AS levels FROM c" for x in ("sparse", "c_nationkey", "c_mktsegment", "one")) + ") SELECT *, missing <= 0.5 AND levels > 1 AS used FROM a")
def _o154(t):
    c = t("customer").withColumn("sparse", F.when(F.col("c_custkey") % 5 >= 3, F.col("c_acctbal"))).withColumn("one", F.when(F.col("c_custkey") % 2 == 0, "x"))
    return covariates(c, ["sparse", "c_nationkey", "c_mktsegment", "one"]).withColumn("missing", F.round("missing", 9))


@query("o155_variable_resolution", "WITH c AS (SELECT c_mktsegment AS cohort, CASE WHEN c_custkey % 100 = 7 THEN 'x' END AS age_a, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' ELSE c_nationkey::VARCHAR END AS age_b, c_name AS age_c FROM customer), l AS (SELECT cohort, 'age' AS variable, 0::INT AS place, 'age_a' AS col, age_a AS v FROM c UNION ALL SELECT cohort, 'age', 1, 'age_b', age_b FROM c UNION ALL SELECT cohort, 'age', 2, 'age_c', age_c FROM c), g AS (SELECT cohort, variable, place, col AS \"column\", count(v) AS n, count(DISTINCT v) AS levels, count(TRY_CAST(v AS DOUBLE)) AS n_numbers FROM l GROUP BY ALL), u AS (SELECT *, n >= 3 AND levels > 1 AS usable, n_numbers >= 0.8 * n AS is_numeric FROM g) SELECT *, coalesce(place = min(CASE WHEN usable THEN place END) OVER (PARTITION BY cohort, variable), false) AS chosen FROM u")
def _o155(t):
    c = t("customer").select(F.col("c_mktsegment").alias("cohort"), F.when(F.col("c_custkey") % 100 == 7, "x").alias("age_a"), F.when(F.col("c_custkey") % 10 == 0, "unknown").otherwise(F.col("c_nationkey").cast("string")).alias("age_b"), F.col("c_name").alias("age_c"))
    return variable_audit(c, {"age": ["age_a", "age_b", "age_c", "absent"]}, "cohort")


@query("o156_patient_id", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS patient_id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS amount, c_mktsegment AS specimen FROM customer")
def _o156(t):
    c = t("customer")
    core = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("  ").alias("id_a"), F.col("c_custkey").alias("id_b"), F.lit(0.0).alias("amount"), F.col("c_mktsegment").alias("specimen"))
    h = c.where("c_custkey % 4 <> 0").select("c_custkey", F.col("c_acctbal").alias("amount"), F.lit("other").alias("specimen"))
    return override(core.withColumn("patient_id", patient_id(core, ["id_0", "id_a", "id_b"])), h, "c_custkey", ["specimen"]).drop("id_a", "id_b")


@query("o157_clinical_encoding", "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey::DOUBLE END AS age, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS sex, (CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 END)::INT AS \"pT\" FROM customer")
def _o157(t):
    k = F.col("c_custkey")
    return encode_clinical(t("customer").select(k, F.when(k % 4 == 0, "unknown").otherwise(F.col("c_nationkey").cast("string")).alias("age"), F.when(k % 3 == 0, " male").when(k % 3 == 1, "F").alias("sex"), F.when(k % 3 == 0, "pTis").when(k % 3 == 1, "ypT2b").otherwise("Tx").alias("pT")))


_TWO = "v AS (SELECT l_suppkey AS patient_id, CASE WHEN l_linestatus = 'O' THEN 'RC' ELSE 'TURBT' END AS sample_type, p_type AS feature, avg(l_quantity) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@query("o158_two_scale_scores", f"WITH {_TWO}, p AS (SELECT feature, sample_type, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY ALL), r AS (SELECT feature, sample_type, m, s, 'internal' AS mode FROM p UNION ALL SELECT feature, x.sample_type, m, s, 'reference' FROM p, (SELECT unnest(['RC', 'TURBT']) AS sample_type) x WHERE p.sample_type = 'TURBT'), z AS (SELECT v.patient_id, v.sample_type, substr(v.feature, 1, 1) AS program, mode, (value - m) / nullif(s, 0) AS z FROM v JOIN r USING (feature, sample_type)) SELECT patient_id, sample_type, program, mode, round(avg(z), 5) AS score, count(z) AS n_present FROM z GROUP BY ALL")
def _o158(t):
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("feature"))
    v = t("lineitem").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("patient_id"), F.when(F.col("l_linestatus") == "O", "RC").otherwise("TURBT").alias("sample_type"), "feature").agg(F.avg("l_quantity").alias("value"))
    m = t("part").select(F.col("p_type").alias("feature"), F.substring("p_type", 1, 1).alias("program")).distinct()
    return two_scale_scores(v, m, "TURBT").withColumn("score", F.round("score", 5))


_EFFECTS = "e AS (SELECT p_type AS program, p_brand AS context, p_size / 50.0::DOUBLE AS p, p_size / 25.0::DOUBLE AS q, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (round(p_retailprice % 7, 2) - 3) AS favourable, p_brand = 'Brand#11' AS held FROM part)"


def _effects(t) -> DataFrame:
    s = F.col("p_size") % 2 == 0
    return t("part").withColumn("coef", F.round(F.col("p_retailprice") % 7, 2) - 3).select(F.col("p_partkey"), F.col("p_type").alias("program"), F.col("p_brand").alias("context"), (F.col("p_size") / 50).alias("p"), (F.col("p_size") / 25).alias("q"), favourable("coef", s).alias("favourable"), (F.col("p_brand") == "Brand#11").alias("held"))


@query("o161_favourable_effect", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (round(p_retailprice % 7, 2) - 3), 6) AS favourable FROM part")
def _o161(t):
    return _effects(t).select("p_partkey", F.round("favourable", 6).alias("favourable"))


@query("o162_recurrence", f"WITH {_EFFECTS} SELECT program, count(*) AS n_contexts, count(*) FILTER (WHERE favourable > 0) AS n_favourable, count(*) FILTER (WHERE favourable < 0) AS n_unfavourable, count(*) FILTER (WHERE favourable > 0 AND p < 0.05) AS nominal_favourable, count(*) FILTER (WHERE favourable > 0 AND q < 0.1) AS q10_favourable, round(median(favourable), 6) AS median_favourable FROM e GROUP BY 1")
def _o162(t):
    return recurrence(_effects(t), ["program"]).withColumn("median_favourable", F.round("median_favourable", 6))


@query("o162_replication", f"WITH {_EFFECTS}, d AS (SELECT program, median(favourable) AS x FROM e WHERE NOT held GROUP BY 1), h AS (SELECT program, median(favourable) AS y FROM e WHERE held GROUP BY 1) SELECT program, round(x, 6) AS discovery, round(y, 6) AS held_out, sign(x) = sign(y) AS same_direction FROM d JOIN h USING (program)")
def _o162b(t):
    e = _effects(t)
    return concordant(e.where("NOT held"), e.where("held"), ["program"]).withColumns({c: F.round(c, 6) for c in ("discovery", "held_out")})


@query("o189_unit_summary", "WITH u AS (SELECT c_mktsegment AS cohort, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS a, CASE WHEN o_custkey % 14 <> 0 THEN 'c' || o_custkey END AS b, o_orderdate AS unit, o_orderstatus AS s, o_totalprice > 100000 AS ready FROM orders JOIN customer ON c_custkey = o_custkey), p AS (SELECT cohort, coalesce(a, b) AS patient_id, count(*) AS n, count(DISTINCT unit) AS u, count(*) FILTER (WHERE ready) AS r, count(DISTINCT s) > 1 AS matched FROM u GROUP BY ALL) SELECT cohort, sum(n)::BIGINT AS n_panel_units, sum(u)::BIGINT AS n_units, sum(r)::BIGINT AS n_ready, count(patient_id) AS n_patients, count(*) FILTER (WHERE matched AND patient_id IS NOT NULL) AS n_matched FROM p GROUP BY 1")
def _o189(t):
    k = F.col("o_custkey")
    o = t("orders").join(t("customer"), F.col("c_custkey") == k).select(F.col("c_mktsegment").alias("cohort"), F.when(k % 7 == 0, " ").otherwise(k.cast("string")).alias("a"), F.when(k % 14 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("b"), F.col("o_orderdate").alias("unit"), F.col("o_orderstatus").alias("sample_type"), (F.col("o_totalprice") > 100000).alias("ready"))
    return unit_summary(o.withColumn("patient_id", patient_id(o, ["a", "b"])), "cohort")


@query("o193_presence_summary", "WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT c_mktsegment AS cohort, o.o_custkey IS NOT NULL AS orders, c_acctbal > 0 AS balance FROM customer LEFT JOIN o ON o_custkey = c_custkey) SELECT cohort, count(*) AS n, count(*) FILTER (WHERE orders) AS n_orders, count(*) FILTER (WHERE balance) AS n_balance, round(count(*) FILTER (WHERE orders) / count(*)::DOUBLE, 9) AS share_orders, round(count(*) FILTER (WHERE balance) / count(*)::DOUBLE, 9) AS share_balance FROM p GROUP BY 1")
def _o193(t):
    o = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    c = t("customer").join(o, "c_custkey", "left").select(F.col("c_mktsegment").alias("cohort"), F.col("hit").isNotNull().alias("orders"), (F.col("c_acctbal") > 0).alias("balance"))
    return presence_summary(c, ["cohort"], ["orders", "balance"]).withColumns({f"share_{c}": F.round(f"share_{c}", 9) for c in ("orders", "balance")})


@query("o194_sample_qc", f"WITH {CELLS}, c AS (SELECT sample_id, count(*) FILTER (WHERE region = 'Tumor') AS \"n_Tumor\", count(*) FILTER (WHERE region = 'Stroma') AS \"n_Stroma\" FROM cells WHERE sample_id % 5 <> 0 GROUP BY 1), t AS (SELECT s_suppkey AS sample_id FROM supplier WHERE s_suppkey % 3 <> 0) SELECT sample_id, coalesce(\"n_Tumor\", 0) AS \"n_Tumor\", coalesce(\"n_Stroma\", 0) AS \"n_Stroma\", c.sample_id IS NOT NULL AS has_cells, t.sample_id IS NOT NULL AS has_tissue, coalesce(\"n_Tumor\" + \"n_Stroma\", 0) AS n_cells FROM c FULL JOIN t USING (sample_id)")
def _o194(t):
    tissue = t("supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("sample_id"))
    return sample_qc(t.cells().where("sample_id % 5 <> 0"), tissue, "sample_id", ["Tumor", "Stroma"])


@query("o196_metric_summary", f"WITH {EVIDENCE}, l AS (SELECT context, 'oof' AS metric, oof AS v, 0.6 AS a, 0.8 AS b FROM evidence UNION ALL SELECT context, 'sd', sd, 0.1, 0.3 FROM evidence) SELECT context, metric, count(v) AS n, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, count(*) FILTER (WHERE v >= a) AS n_reach_1, count(*) FILTER (WHERE v >= b) AS n_reach_2 FROM l GROUP BY ALL")
def _o196(t):
    m = metric_summary(t.evidence(), ["context"], ["oof", "sd"], {"oof": [0.6, 0.8], "sd": [0.1, 0.3]})
    return m.withColumns({q: F.round(q, 6) for q in ("q25", "q50", "q75")})
