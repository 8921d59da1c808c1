"""Marker calls, labels, filters: O021 to O044."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import CELLS, EVIDENCE, FEATURES, query


def combine_calls(calls: DataFrame, keys: list[str], marker: str, positive: str, blank: str) -> DataFrame:
    """O021, O022, O061, O067, O068: positive markers of each cell as a sorted set; ALL_NEG if none; whether any call was blank."""
    pos = F.array_sort(F.collect_set(F.when(F.col(positive), F.col(marker))))
    g = calls.groupBy(*keys).agg(pos.alias("s"), F.bool_or(F.col(blank)).alias("any_blank"))
    return g.select(*keys, F.when(F.size("s") == 0, "ALL_NEG").otherwise(F.array_join("s", ";")).alias("combo"), F.size("s").alias("n_positive"), "any_blank")


def combine_calls_by_row(calls: DataFrame, keys: list[str], order: list[str], marker: str, positive: str, blank: str) -> DataFrame:
    """O022: as combine_calls, but the first row of a key in each marker's file meets the first of the others, the second the second and so on, so repeated keys stay rows of their own. `order` is the order of rows in the files."""
    w = Window.partitionBy(marker, *keys).orderBy(*order)
    return combine_calls(calls.withColumn("occurrence", F.row_number().over(w)), [*keys, "occurrence"], marker, positive, blank)


def coordinate(text: Column) -> Column:
    """O023: the last `[x,y]` token, as x_y; null if there is none."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\[\s*(\d+)\s*,\s*(\d+)\s*\]"), F.lit(0)), F.lit(-1))
    return F.regexp_replace(F.regexp_replace(last, r"[\[\]\s]", ""), ",", "_")


def canonical(combo: Column, positive_only: bool = False) -> Column:
    """O025, O026: tokens split at ; or /, trimmed, without negatives, sorted and distinct."""
    tokens = F.filter(F.transform(F.split(combo, "[;/]"), lambda t: F.trim(t)), lambda t: (t != "") & (t.endswith("+") if positive_only else ~t.endswith("-")))
    s = F.array_sort(F.array_distinct(tokens))
    return F.when(F.size(s) == 0, "ALL_NEG").otherwise(F.array_join(s, ";"))


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """O027: the first reason that holds."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in reasons])


def all_reasons(checks: list[tuple[str, Column]]) -> Column:
    """O037: every failed check, ;-joined; a null input passes."""
    return F.concat_ws(";", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks])


def slices(df: DataFrame, region: str = "region") -> DataFrame:
    """O033, O072: each row in its own region's slice and in All."""
    return df.withColumn("slice", F.explode(F.array(F.lit("All"), F.col(region))))


def rule_filter(df: DataFrame, rules: DataFrame, on: str, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """O038: thresholds by context; a null threshold is inactive, a null value fails an active one. checks: name -> (value column, threshold column); names that start with max_ bound from above."""
    j = df.join(F.broadcast(rules), on, "left")
    ok = {n: F.col(t).isNull() | (F.col(v).isNotNull() & F.coalesce((F.col(v) <= F.col(t)) if n.startswith("max_") else (F.col(v) >= F.col(t)), F.lit(False))) for n, (v, t) in checks.items()}
    return j.withColumn("failed", F.concat_ws(";", *[F.when(~c, F.lit(n)) for n, c in ok.items()])).withColumn("kept", reduce(lambda a, b: a & b, ok.values()))


def coverage(features: DataFrame, n_patients: int, least: tuple[float, int, int] = (0.7, 3, 5)) -> DataFrame:
    """O041: how many patients have a value, and why a feature is dropped."""
    g = features.groupBy("feature").agg(F.count("value").alias("n_nonmissing"), F.count_distinct("value").alias("n_unique"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
    frac = F.col("n_nonmissing") / n_patients
    why = F.when(frac < least[0], "coverage").when(F.col("n_unique") < least[1], "n_unique").when(F.col("n_nonzero") < least[2], "n_nonzero")
    return g.select("feature", "n_nonmissing", frac.alias("nonmissing_frac"), "n_unique", "n_nonzero", why.alias("reason"))


@query("o021_marker_combine", "SELECT user_id, coalesce(nullif(string_agg(DISTINCT event_type, ';' ORDER BY event_type) FILTER (WHERE value > 50), ''), 'ALL_NEG') AS combo, count(DISTINCT event_type) FILTER (WHERE value > 50)::INT AS n_positive, bool_or(event_id % 11 = 0) AS any_blank FROM events GROUP BY user_id")
def _o021(t):
    e = t("events").select("user_id", "event_type", (F.col("value") > 50).alias("positive"), (F.col("event_id") % 11 == 0).alias("blank"))
    return combine_calls(e, ["user_id"], "event_type", "positive", "blank")


@query("o023_coordinate_token", "WITH s AS (SELECT p_partkey, 'core [' || p_size || ', ' || (p_partkey % 7) || ']_' || CASE WHEN p_partkey % 3 = 0 THEN '[9,' || p_size || ']' ELSE 'x' END AS t FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '9_' || p_size ELSE p_size || '_' || (p_partkey % 7) END AS coord_key FROM (SELECT s.*, p_size FROM s JOIN part USING (p_partkey))".replace("SELECT s.*, p_size FROM s", "SELECT s.p_partkey, part.p_size FROM s"))
def _o023(t):
    text = F.concat(F.lit("core ["), "p_size", F.lit(", "), F.col("p_partkey") % 7, F.lit("]_"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("[9,"), "p_size", F.lit("]"))).otherwise("x"))
    return t("part").select("p_partkey", coordinate(text).alias("coord_key"))


@query("o024_label_normalise", "SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'BUILDING' THEN 'bld' WHEN 'MACHINERY' THEN 'mch' ELSE lower(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', '_', 'g')) END AS cohort, c_acctbal > 0 AS is_positive FROM customer")
def _o024(t):
    m = F.upper(F.trim("c_mktsegment"))
    return t("customer").select("c_custkey", F.when(m == "BUILDING", "bld").when(m == "MACHINERY", "mch").otherwise(F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z0-9]+", "_"))).alias("cohort"), (F.col("c_acctbal") > 0).alias("is_positive"))


@query("o025_canonical_combination", "WITH s AS (SELECT p_partkey, string_split(replace(p_type || '+;CD8-/' || p_brand || '+; ;' || p_type || '+', '/', ';'), ';') AS a FROM part), u AS (SELECT p_partkey, trim(unnest(a)) AS k FROM s) SELECT p_partkey, string_agg(DISTINCT k, ';' ORDER BY k) AS canonical, string_agg(DISTINCT k, ';' ORDER BY k) FILTER (WHERE k LIKE '%+') AS positive_only FROM u WHERE k <> '' AND k NOT LIKE '%-' GROUP BY p_partkey")
def _o025(t):
    c = F.concat("p_type", F.lit("+;CD8-/"), "p_brand", F.lit("+; ;"), "p_type", F.lit("+"))
    return t("part").select("p_partkey", canonical(c).alias("canonical"), canonical(c, True).alias("positive_only"))


@query("o027_exclusion_reasons", "SELECT CASE WHEN l_discount > 0.08 THEN 'artifact' WHEN l_tax > 0.06 THEN 'exploratory' WHEN l_returnflag = 'R' THEN 'excluded_label' ELSE 'primary' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def _o027(t):
    r = first_reason([("artifact", F.col("l_discount") > 0.08), ("exploratory", F.col("l_tax") > 0.06), ("excluded_label", F.col("l_returnflag") == "R")])
    return t("lineitem").groupBy(F.coalesce(r, F.lit("primary")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("o028_derived_label_views", f"WITH {CELLS} SELECT phenotype, region, phenotype || '__' || lower(region) AS with_state, CASE WHEN phenotype IN ('STANDARD', 'PROMO') THEN 'immune' WHEN phenotype = 'ECONOMY' THEN 'tumor' ELSE 'stroma' END AS compartment, count(*) AS n FROM cells GROUP BY ALL")
def _o028(t):
    comp = F.when(F.col("phenotype").isin("STANDARD", "PROMO"), "immune").when(F.col("phenotype") == "ECONOMY", "tumor").otherwise("stroma")
    return t.cells().groupBy("phenotype", "region", F.concat_ws("__", "phenotype", F.lower("region")).alias("with_state"), comp.alias("compartment")).agg(F.count(F.lit(1)).alias("n"))


@query("o030_phenotype_map", "WITH m AS (SELECT p_brand AS panel, p_type AS canonical, p_size AS label, p_retailprice AS cells, p_partkey AS id FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY panel, canonical ORDER BY cells DESC, id) AS k, FROM m), c AS (SELECT panel, canonical, count(DISTINCT label) AS n_labels FROM m GROUP BY ALL) SELECT r.panel, r.canonical, r.label::VARCHAR AS label, n_labels > 1 AS conflict FROM r JOIN c USING (panel, canonical) WHERE k = 1 UNION ALL SELECT DISTINCT panel, 'ALL_NEG', 'other', false FROM m")
def _o030(t):
    m = t("part").select(F.col("p_brand").alias("panel"), F.col("p_type").alias("canonical"), F.col("p_size").alias("label"), F.col("p_retailprice").alias("cells"), F.col("p_partkey").alias("id"))
    best = m.groupBy("panel", "canonical").agg(F.min_by("label", F.struct(-F.col("cells"), F.col("id"))).cast("string").alias("label"), (F.count_distinct("label") > 1).alias("conflict"))
    return best.unionByName(m.select("panel").distinct().select("panel", F.lit("ALL_NEG").alias("canonical"), F.lit("other").alias("label"), F.lit(False).alias("conflict")))


@query("o031_label_join_fallback", "WITH m AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0) SELECT coalesce(m.n_name, 'UNMAPPED') AS label, count(*) AS n FROM customer LEFT JOIN m ON c_nationkey = m.n_nationkey GROUP BY 1")
def _o031(t):
    m = t("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t("customer").join(F.broadcast(m), "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("UNMAPPED")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("o032_final_label", f"WITH {CELLS} SELECT CASE WHEN phenotype IN ('LARGE', 'SMALL') AND region <> 'Stroma' THEN phenotype || '_' || lower(region) ELSE phenotype END AS label, count(*) AS n FROM cells GROUP BY 1")
def _o032(t):
    label = F.when(F.col("phenotype").isin("LARGE", "SMALL") & (F.col("region") != "Stroma"), F.concat_ws("_", "phenotype", F.lower("region"))).otherwise(F.col("phenotype"))
    return t.cells().groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("o033_region_slices", f"WITH {CELLS} SELECT sample_id, slice, count(*) AS n FROM (SELECT sample_id, 'All' AS slice FROM cells UNION ALL SELECT sample_id, region FROM cells) GROUP BY ALL")
def _o033(t):
    return slices(t.cells()).groupBy("sample_id", "slice").agg(F.count(F.lit(1)).alias("n"))


@query("o034_min_cells", f"WITH {CELLS} SELECT sample_id, count(*) AS n FROM cells WHERE lower(phenotype) IN ('large', 'small') GROUP BY 1 HAVING count(*) >= 100")
def _o034(t):
    return t.cells().where(F.lower("phenotype").isin("large", "small")).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 100")


@query("o035_percent_autodetect", "SELECT p_partkey, CASE WHEN (SELECT max(p_size) FROM part) > 1 THEN p_size / 100.0::DOUBLE ELSE p_size END AS fraction FROM part WHERE CASE WHEN (SELECT max(p_size) FROM part) > 1 THEN p_size / 100.0::DOUBLE ELSE p_size END >= 0.1")
def _o035(t):
    p = t("part")
    top = F.broadcast(p.agg(F.max("p_size").alias("top")))
    return p.join(top, F.lit(True)).select("p_partkey", F.when(F.col("top") > 1, F.col("p_size") / 100.0).otherwise(F.col("p_size")).alias("fraction")).where("fraction >= 0.1")


@query("o037_eligibility_reasons", "SELECT c_custkey, concat_ws(';', CASE WHEN nullif(c_acctbal, 0) < 0 THEN 'balance' END, CASE WHEN c_nationkey < 5 THEN 'nation' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS reasons FROM customer")
def _o037(t):
    return t("customer").select("c_custkey", all_reasons([("balance", F.nullif("c_acctbal", F.lit(0.0)) < 0), ("nation", F.col("c_nationkey") < 5), ("segment", F.col("c_mktsegment") == "BUILDING")]).alias("reasons"))


@query("o038_rule_thresholds", f"WITH {EVIDENCE}, rules AS (SELECT p_brand AS context, nullif(min(p_size) % 2, 0) * 0.3 AS min_oof, CASE WHEN p_brand < 'Brand#3' THEN 0.4 END AS max_sd FROM part GROUP BY p_brand), c AS (SELECT feature, min_oof IS NULL OR coalesce(oof >= min_oof, false) AS a, max_sd IS NULL OR coalesce(sd <= max_sd, false) AS b FROM evidence LEFT JOIN rules USING (context)) SELECT feature, concat_ws(';', CASE WHEN NOT a THEN 'min_oof' END, CASE WHEN NOT b THEN 'max_sd' END) AS failed, a AND b AS kept FROM c")
def _o038(t):
    rules = t("part").groupBy(F.col("p_brand").alias("context")).agg(F.min("p_size").alias("s")).select("context", (F.nullif(F.col("s") % 2, F.lit(0)) * 0.3).alias("min_oof"), F.when(F.col("context") < "Brand#3", 0.4).alias("max_sd"))
    return rule_filter(t.evidence(), rules, "context", {"min_oof": ("oof", "min_oof"), "max_sd": ("sd", "max_sd")}).select("feature", "failed", "kept")


@query("o039_excluded_features", f"WITH {FEATURES} SELECT feature, count(*) AS n FROM features WHERE NOT regexp_matches(feature, '^(qty_Brand#1|disc_.*5$)') AND feature NOT IN ('qty_Brand#22') GROUP BY 1")
def _o039(t):
    return t.features().where(~F.col("feature").rlike("^(qty_Brand#1|disc_.*5$)") & ~F.col("feature").isin("qty_Brand#22")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("o041_feature_coverage", f"WITH {FEATURES}, n AS (SELECT count(DISTINCT patient_id) AS n FROM features), f AS (SELECT feature, CASE WHEN patient_id % 4 <> 0 OR feature LIKE 'qty%' THEN value END AS value FROM features), g AS (SELECT feature, count(value) AS n_nonmissing, count(DISTINCT value) AS n_unique, count(*) FILTER (WHERE value <> 0) AS n_nonzero FROM f GROUP BY 1) SELECT feature, n_nonmissing, round(n_nonmissing / n::DOUBLE, 9) AS nonmissing_frac, n_nonzero, CASE WHEN n_nonmissing / n::DOUBLE < 0.7 THEN 'coverage' WHEN n_unique < 3 THEN 'n_unique' WHEN n_nonzero < 5 THEN 'n_nonzero' END AS reason FROM g, n")
def _o041(t):
    f = t.features()
    n = f.select("patient_id").distinct().count()
    f = f.withColumn("value", F.when((F.col("patient_id") % 4 != 0) | F.col("feature").like("qty%"), F.col("value")))
    return coverage(f, n).select("feature", "n_nonmissing", F.round("nonmissing_frac", 9).alias("nonmissing_frac"), "n_nonzero", "reason")


@query("o043_feature_chunks", f"WITH {FEATURES} SELECT feature, ntile(7) OVER (ORDER BY feature)::INT AS chunk FROM (SELECT DISTINCT feature FROM features)")
def _o043(t):
    return t.features().select("feature").distinct().withColumn("chunk", F.ntile(7).over(Window.orderBy("feature")))


@query("o044_predictive_gate", f"WITH {EVIDENCE} SELECT feature, CASE WHEN transform = 0 THEN oof >= 0.6 AND sd <= 0.3 ELSE oof >= 0.55 END AS passes FROM evidence")
def _o044(t):
    return t.evidence().select("feature", F.when(F.col("transform") == 0, (F.col("oof") >= 0.6) & (F.col("sd") <= 0.3)).otherwise(F.col("oof") >= 0.55).alias("passes"))


@query("o022_row_aligned_merge", "WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS occurrence FROM events) SELECT user_id, occurrence::INT AS occurrence, coalesce(string_agg(DISTINCT event_type, ';' ORDER BY event_type) FILTER (WHERE value > 50), 'ALL_NEG') AS combo, count(DISTINCT event_type) FILTER (WHERE value > 50) AS n_positive, bool_or(value < 5) AS any_blank FROM e GROUP BY ALL")
def _o022(t):
    e = t("events").select("user_id", "event_id", "event_type", (F.col("value") > 50).alias("pos"), (F.col("value") < 5).alias("blank"))
    return combine_calls_by_row(e, ["user_id"], ["event_id"], "event_type", "pos", "blank")
