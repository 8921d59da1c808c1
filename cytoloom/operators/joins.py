"""Joins: O045 to O059."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import EVIDENCE, query


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """O047, O081: raises if a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{what}: keys {keys} occur more than once, such as {[tuple(r)[:-1] for r in twice]}")
    return df


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one", suffix: str = "_right") -> DataFrame:
    """O045 to O048: an equi-join with checked cardinality; clashing columns of the right side get a suffix."""
    if validate.endswith("to_one"):
        assert_unique(right, on, "right side")
    if validate.startswith("one_to"):
        assert_unique(left, on, "left side")
    clash = [c for c in right.columns if c in left.columns and c not in on]
    return left.join(right.withColumnsRenamed({c: c + suffix for c in clash}), on, how)


def exact_then_fallback(left: DataFrame, right: DataFrame, exact: list[str], loose: list[str], value: str) -> DataFrame:
    """O050: the value of the exact key, else that of the looser key's first row."""
    a = right.groupBy(*exact).agg(F.min(value).alias("_exact"))
    b = right.groupBy(*loose).agg(F.min(value).alias("_loose"))
    return left.join(a, exact, "left").join(b, loose, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def complete_grid(counts: DataFrame, rows: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """O052: every row with every label, zero where there is no count. Labels are a checked, small dimension."""
    names = sorted(r[0] for r in labels.distinct().limit(10_001).collect())
    if len(names) > 10_000:
        raise ValueError("too many labels for a grid")
    grid = rows.distinct().withColumn(labels.columns[0], F.explode(F.array(*map(F.lit, names))))
    return grid.join(counts, grid.columns, "left").fillna({value: 0})


def pair_gaps(df: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """O057: (keys, n_pairs, gap): the pairs of unlike items of a key and the sum of their values' absolute differences (null if no pair has both values), without any pair as a row.

    In the order of values, a value lies above all before it: running numbers and sums of the distinct values give the sum. Rows of one item are
    no pair: what such rows have among themselves is taken off. Rows with a null key or item have no pairs.
    """
    d = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, item])).select(*keys, item, F.col(value).cast("double").alias("_v"))

    def among(x: DataFrame, by: list[str]) -> DataFrame:
        n = x.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"), F.count("_v").alias("_m"))
        w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        before, total = F.coalesce(F.sum("_m").over(w), F.lit(0)), F.coalesce(F.sum(F.col("_v") * F.col("_m")).over(w), F.lit(0.0))
        n = n.withColumn("_gap", F.col("_m") * (F.col("_v") * before - total))
        two = lambda c: F.sum(c) * (F.sum(c) - 1) / 2
        return n.groupBy(*by).agg(two("_n").cast("long").alias("n_pairs"), two("_m").cast("long").alias("_known"), F.coalesce(F.sum("_gap"), F.lit(0.0)).alias("gap"))

    twice = d.join(d.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), [*keys, item], "left_semi")
    own = among(twice, [*keys, item]).select(*keys, *((-F.col(c)).alias(c) for c in ("n_pairs", "_known", "gap")))
    both = among(d, keys).unionByName(own).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_pairs", "_known", "gap")))
    return both.where("n_pairs > 0").select(*keys, "n_pairs", F.when(F.col("_known") > 0, F.col("gap")).alias("gap"))


def rescues(df: DataFrame, keys: list[str], item: str, level: str, value: str, most: int, loss: float, context: str) -> DataFrame:
    """O059: (context, item, simpler): for each item the `most` best items of its keys on lower levels (greatest value, then least item) that lose no more than `loss`, to six places. context: one of keys.

    Of a level's lower items only the `most` best count, since a better one never loses more: they are found once a level, and no other pair is a row.
    """
    b = df.where(F.col(value).isNotNull()).select(*keys, F.col(level).alias("_level"), F.col(item).alias("simpler"), F.col(value).alias("_value"))
    best = lambda d, by: d.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_value"), "simpler"))).where(F.col("_k") <= most).drop("_k")
    tops = best(b, [*keys, "_level"]).withColumnRenamed("_level", "_lower")
    below = best(df.select(*keys, level).distinct().join(tops, keys).where(F.col("_lower") < F.col(level)), [*keys, level]).drop("_lower")
    j = df.join(below, [*keys, level]).where(F.round(F.col(value) - F.col("_value"), 6) <= loss)
    return best(j, [context, item]).select(context, item, "simpler")


@query("o045_inner_join", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _o045(t):
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("o047_validated_left_join", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def _o047(t):
    c = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return join_validated(t("orders"), c, ["o_custkey"]).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("o048_full_outer_join", "WITH a AS (SELECT l_suppkey AS k, count(*) AS na FROM lineitem GROUP BY 1 HAVING count(*) % 3 <> 0), b AS (SELECT s_suppkey AS k, s_acctbal FROM supplier WHERE s_acctbal > 0) SELECT k, na, s_acctbal FROM a FULL JOIN b USING (k)")
def _o048(t):
    a = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("na")).where("na % 3 <> 0")
    return a.join(t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), "s_acctbal"), "k", "full_outer")


@query("o050_exact_then_fallback", "WITH r AS (SELECT l_suppkey, l_returnflag, min(l_tax) AS e FROM lineitem WHERE l_quantity = 1 GROUP BY ALL), f AS (SELECT l_suppkey, min(l_tax) AS g FROM lineitem WHERE l_quantity = 1 GROUP BY ALL) SELECT DISTINCT l.l_suppkey, l.l_returnflag, coalesce(e, g) AS l_tax FROM lineitem l LEFT JOIN r USING (l_suppkey, l_returnflag) LEFT JOIN f USING (l_suppkey)")
def _o050(t):
    x = t("lineitem")
    return exact_then_fallback(x.select("l_suppkey", "l_returnflag").distinct(), x.where("l_quantity = 1"), ["l_suppkey", "l_returnflag"], ["l_suppkey"], "l_tax").select("l_suppkey", "l_returnflag", "l_tax")


@query("o051_crosswalk", "WITH c AS (SELECT c_custkey, coalesce(nullif(upper(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name END)), ''), upper(c_mktsegment)) AS k FROM customer), m AS (SELECT DISTINCT upper(c_mktsegment) AS k FROM customer) SELECT c_custkey, m.k IS NOT NULL AS matched FROM c LEFT JOIN m USING (k)")
def _o051(t):
    c = t("customer")
    key = F.coalesce(F.nullif(F.upper(F.trim(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))), F.lit("")), F.upper("c_mktsegment"))
    m = c.select(F.upper("c_mktsegment").alias("k")).distinct().withColumn("matched", F.lit(True))
    return c.select("c_custkey", key.alias("k")).join(m, "k", "left").select("c_custkey", F.coalesce("matched", F.lit(False)).alias("matched"))


@query("o052_grid_zero_fill", "WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS kind FROM part) SELECT s.s_suppkey, p.kind, count(l_partkey) AS n FROM supplier s CROSS JOIN (SELECT DISTINCT kind FROM p) p LEFT JOIN (SELECT l_suppkey, l_partkey, kind FROM lineitem JOIN p ON p_partkey = l_partkey) l ON l.l_suppkey = s.s_suppkey AND l.kind = p.kind GROUP BY ALL")
def _o052(t):
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("kind"))
    n = t("lineitem").join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("s_suppkey"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return complete_grid(n, t("supplier").select("s_suppkey"), p.select("kind"), "n")


@query("o053_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _o053(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("o054_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _o054(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("o057_feature_pairs", f"WITH {EVIDENCE} SELECT a.context, count(*) AS n_pairs, round(sum(abs(a.oof - b.oof)), 6) AS gap FROM evidence a JOIN evidence b ON a.context = b.context AND a.source = b.source AND a.feature < b.feature GROUP BY 1")
def _o057(t):
    g = pair_gaps(t.evidence(), ["context", "source"], "feature", "oof").groupBy("context").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("gap").alias("gap"))
    return g.select("context", "n_pairs", F.round("gap", 6).alias("gap"))


@query("o058_matched_pairs", "WITH r AS (SELECT o_custkey, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS b, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT DISTINCT o_custkey, round(b - a, 4) AS delta FROM r WHERE n > 1")
def _o058(t):
    at = F.struct("o_orderdate", "o_orderkey")
    g = t("orders").groupBy("o_custkey").agg(F.min_by("o_totalprice", at).alias("a"), F.max_by("o_totalprice", at).alias("b"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").select("o_custkey", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


@query("o059_rescue_join", f"WITH {EVIDENCE}, j AS (SELECT a.context, a.feature, b.feature AS simpler, row_number() OVER (PARTITION BY a.context, a.feature ORDER BY b.oof DESC, b.feature) AS k FROM evidence a JOIN evidence b ON a.context = b.context AND a.source = b.source AND b.transform < a.transform AND round(a.oof - b.oof, 6) <= 0.05) SELECT context, feature, simpler FROM j WHERE k <= 2")
def _o059(t):
    return rescues(t.evidence(), ["context", "source"], "feature", "transform", "oof", 2, 0.05, "context")
