"""Scalar functions: O116 to O131."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import FEATURES, query


def sanitise(c: Column) -> Column:
    """O116: + and - spelt out, other runs of odd characters to one underscore."""
    c = F.replace(F.replace(F.trim(c), F.lit("+"), F.lit("pos")), F.lit("-"), F.lit("neg"))
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def rounded(c: Column | str, places: int) -> Column:
    """A number to so many places as SQL engines round doubles: the product with a power of ten, to the nearest whole number (halves away from zero), over it. F.round rounds the number's decimal form, which differs where a half is meant."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 10.0**places) / 10.0**places


def number(c: Column) -> Column:
    """O118: a number from text with commas or a percent sign; null where there is none or it is infinite or not a number."""
    x = F.regexp_replace(F.trim(c), "[,%]", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def truth(c: Column) -> Column:
    """O119: true and false words and numbers; null otherwise."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("1", "true", "t", "yes", "y", "1.0"), True).when(s.isin("0", "false", "f", "no", "n", "0.0"), False)


def stage(c: Column) -> Column:
    """O120, O157: the ordinal of a stage: is and a are 0, else the first digits."""
    s = F.regexp_replace(F.lower(F.trim(c)), "^[ycp]*", "")
    return F.when(s.rlike("^t?(is|a)"), 0).otherwise(F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit("")).try_cast("int"))


def normal_p(z: Column) -> Column:
    """O121: two-sided p of a z score, by the Abramowitz-Stegun 7.1.26 approximation of erfc (absolute error under 2e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def zscore(value: str, window, sample_sd: bool = True, log1p: bool = False) -> Column:
    """O122: null where the sd is 0; sample or population sd by name; with log1p of ln(1 + value), where a negative value is an error."""
    v = F.col(value)
    if log1p:
        v = F.when(v < 0, F.raise_error(F.lit(f"{value}: log1p of a negative value")).cast("double")).otherwise(F.log1p(v))
    sd = F.stddev_samp(v) if sample_sd else F.stddev_pop(v)
    return F.try_divide(v - F.avg(v).over(window), F.nullif(sd.over(window), F.lit(0.0)))


def one_hot(df: DataFrame, train: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """O124: a 0/1 column for each level of a column but the first, in sorted order; levels are those of the training rows (at most `most` a column, or an error). Levels that training rows lack, and nulls, are 0 throughout."""
    out = [F.col(c) for c in df.columns if c not in columns]
    for c in columns:
        levels = sorted(r[0] for r in train.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect())
        if len(levels) > most:
            raise ValueError(f"{c} has more than {most} levels")
        out += [F.coalesce((F.col(c).cast("string") == x).cast("int"), F.lit(0)).alias(f"{c}_{x}") for x in levels[1:]]
    return df.select(*out)


def jaccard(a: Column, b: Column) -> Column:
    """O127: of two token arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def vector_hash(values: Column) -> Column:
    """O126: sha1 of values to twelve decimals, as text: whole numbers of 10^-12, since engines print the same double in unlike ways near a half."""
    return F.sha1(F.array_join(F.transform(values, lambda v: F.floor(v * 1e12 + 0.5).cast("string")), ",").cast("binary"))


@query("o116_sanitise", "SELECT p_partkey, trim(regexp_replace(replace(replace(p_name || ' +/-' || p_type, '+', 'pos'), '-', 'neg'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def _o116(t):
    return t("part").select("p_partkey", sanitise(F.concat("p_name", F.lit(" +/-"), "p_type")).alias("slug"))


@query("o117_regex", """SELECT event_id, regexp_extract(props, '"k": (\\d+)', 1)::INT AS k, regexp_matches(props, '9') AS has_nine, len(regexp_extract_all(props, '\\d'))::INT AS digits FROM events""")
def _o117(t):
    return t("events").select("event_id", F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"), F.col("props").rlike("9").alias("has_nine"), F.size(F.regexp_extract_all("props", F.lit(r"(\d)"), F.lit(1))).alias("digits"))


@query("o118_tolerant_cast", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 1 THEN c_custkey END::DOUBLE AS v, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM customer")
def _o118(t):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"), F.lit("%"))).when(k % 4 == 1, F.format_number(k, 0)).when(k % 4 == 2, "Infinity").otherwise("n/a")
    return t("customer").select("c_custkey", number(text).alias("v"), truth(F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "F").otherwise("?")).alias("b"))


@query("o120_stage_parse", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN p_size % 10 WHEN 3 THEN 2 END::INT AS stage FROM part")
def _o120(t):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "pTis").when(k == 1, "cTa").when(k == 2, F.concat(F.lit("ypT"), (F.col("p_size") % 10).cast("string"), F.lit("b"))).when(k == 3, "N2").otherwise("NX")
    return t("part").select("p_partkey", stage(text).alias("stage"))


@query("o121_math", "WITH e AS (SELECT event_id, (value - 50) / 20 AS z FROM events) SELECT event_id, round(ln(1 + abs(z)), 6) AS log1p, round(-log10(greatest(abs(z), 1e-6)), 6) AS nlog, sign(z)::DOUBLE AS sgn, ceil(z)::BIGINT AS up FROM e")
def _o121(t):
    z = (F.col("value") - 50) / 20
    return t("events").select("event_id", F.round(F.log1p(F.abs(z)), 6).alias("log1p"), F.round(-F.log10(F.greatest(F.abs(z), F.lit(1e-6))), 6).alias("nlog"), F.signum(z).alias("sgn"), F.ceil(z).alias("up"))


@query("o122_zscore", f"WITH {FEATURES}, f AS (SELECT patient_id, feature, CASE WHEN feature = 'qty_Brand#1' THEN 1.0 ELSE value END AS value FROM features) SELECT patient_id, feature, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 5) AS z FROM f WINDOW w AS (PARTITION BY feature)")
def _o122(t):
    from pyspark.sql import Window

    f = t.features().withColumn("value", F.when(F.col("feature") == "qty_Brand#1", 1.0).otherwise(F.col("value")))
    return f.select("patient_id", "feature", F.round(zscore("value", Window.partitionBy("feature")), 5).alias("z"))


@query("o123_reference_zscore", f"WITH {FEATURES}, p AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM features WHERE patient_id % 2 = 0 GROUP BY 1) SELECT patient_id, feature, round((value - m) / nullif(s, 0), 5) AS z FROM features JOIN p USING (feature)")
def _o123(t):
    f = t.features()
    p = f.where("patient_id % 2 = 0").groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return f.join(p, "feature").select("patient_id", "feature", F.round(F.try_divide(F.col("value") - F.col("m"), F.nullif("s", F.lit(0.0))), 5).alias("z"))


@query("o124_one_hot_impute", "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS seg_building, (c_mktsegment = 'MACHINERY')::INT AS seg_machinery, coalesce(nullif(c_nationkey, 3), (SELECT median(nullif(c_nationkey, 3)) FROM customer))::DOUBLE AS nation FROM customer")
def _o124(t):
    c = t("customer").withColumn("n", F.nullif("c_nationkey", F.lit(3)))
    m = F.broadcast(c.agg(F.median("n").alias("m")))
    return c.join(m, F.lit(True)).select("c_custkey", *[(F.col("c_mktsegment") == s).cast("int").alias(f"seg_{s.lower()}") for s in ("BUILDING", "MACHINERY")], F.coalesce("n", "m").cast("double").alias("nation"))


@query("o126_vector_hash", "SELECT vec_id, sha1(array_to_string(list_transform(embedding, lambda v: floor(v::DOUBLE * 1e12::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR), ',')) AS h FROM embeddings")
def _o126(t):
    return t("embeddings").select("vec_id", vector_hash(F.transform("embedding", lambda v: v.cast("double"))).alias("h"))


@query("o127_set_similarity", "WITH s AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS a, list_distinct(string_split(p_type || ' ' || p_brand, ' ')) AS b FROM part) SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 9) AS j FROM s")
def _o127(t):
    a, b = F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.split(F.concat_ws(" ", "p_type", "p_brand"), " ")
    return t("part").select("p_partkey", F.round(jaccard(a, b), 9).alias("j"))


@query("o129_keys_and_ids", """SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS key, p_type || '|' || p_brand || '|' || p_name AS uid, p_name AS feature FROM part""")
def _o129(t):
    uid = F.concat_ws("|", "p_type", "p_brand", "p_name")
    return t("part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("key"), uid.alias("uid"), F.split(uid, r"\|", 3)[2].alias("feature"))


@query("o131_display", "SELECT event_type, count(*) FILTER (WHERE value > 50) || ' (' || printf('%.1f', 100.0 * count(*) FILTER (WHERE value > 50) / count(*)) || '%)' AS n_pct, printf('%.4f', median(value)) || ' (' || printf('%.4f', quantile_cont(value, 0.25)) || '-' || printf('%.4f', quantile_cont(value, 0.75)) || ')' AS spread FROM events GROUP BY 1")
def _o131(t):
    n = F.count_if(F.col("value") > 50)
    q = [F.percentile("value", F.lit(p)) for p in (0.5, 0.25, 0.75)]
    return t("events").groupBy("event_type").agg(F.format_string("%d (%.1f%%)", n, 100.0 * n / F.count(F.lit(1))).alias("n_pct"), F.format_string("%.4f (%.4f-%.4f)", *q).alias("spread"))


@query("o122_log1p_zscore", f"WITH {FEATURES}, f AS (SELECT patient_id, feature, ln(1 + value) AS v FROM features) SELECT patient_id, feature, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 5) AS z FROM f WINDOW w AS (PARTITION BY feature)")
def _o122_log1p(t):
    from pyspark.sql import Window

    return t.features().select("patient_id", "feature", F.round(zscore("value", Window.partitionBy("feature"), sample_sd=False, log1p=True), 5).alias("z"))


@query("o124_one_hot", "SELECT o_orderkey, (o_orderstatus = 'O')::INT AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INT AS \"o_orderstatus_P\" FROM orders")
def _o124_levels(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return one_hot(o, o.where("o_orderkey % 2 = 0"), ["o_orderstatus"])
