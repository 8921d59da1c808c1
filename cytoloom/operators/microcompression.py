"""Compression of features that measure the same, by their patient vectors and evidence: O166 to O168.

A registry has one row a feature: the keys of `by`, feature, oof (out-of-fold metric), any other evidence, exact_key and summary_key (of the parsed
name; null where it could not be parsed), summary. Values are long: the keys of `by`, feature, patient_id, value; a missing or null value is missing.
Passes compare only features of one key, and what meets in a task is the pairs of one key, never vectors of all features.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import feature_grammar as grammar
from ..plans.registry import query
from ..sources.scratch import kept
from .aggregates import spearman_pairs

# The passes' limits.
TOLERANCE, SUMMARY_RHO, RESIDUAL_RHO, MOST_LOSS, LEAST_N = 1e-12, 0.95, 0.98, 0.005, 20
LOCATIONS = ["mean", "median"]


def evidence_order(registry: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds `place`, 1 for the best-evidenced feature of a key: by `order`, then by name; nulls come last."""
    return registry.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "feature")))


def near_equal_vectors(registry: DataFrame, values: DataFrame, by: list[str], key: str = "exact_key", atol: float = TOLERANCE) -> DataFrame:
    """O166: pairs (by, key, a, b) of features of one key, a before b in evidence, whose vectors are missing for the same patients and differ by at most `atol` everywhere. A feature without a key equals none of another name.

    Vectors that near have sums no further apart than n * atol, so candidates share the pattern of patients and a bucket of their sums of that
    width, or lie in neighbouring ones; then each coordinate is compared. Vectors without any value equal nothing.
    """
    same = F.coalesce(F.col(key), F.concat(F.lit("raw feature: "), "feature"))
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "feature").agg(F.sort_array(F.collect_list(F.struct("patient_id", F.col("value").cast("double").alias("x")))).alias("v"))
    r = registry.select(*by, "feature", "place", same.alias("key")).join(v, [*by, "feature"])
    xs = F.transform("v", lambda e: e["x"])
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    # rounding of a sum stays far below 2^-50 of its largest partial sum for vectors of some thousand patients
    width = F.size("v") * (F.lit(2.0 * atol) + F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x)) * F.lit(2.0**-50) + F.lit(1e-300))
    # a width that pairs share: the next power of two
    step = F.pow(F.lit(2.0), F.ceil(F.log2(width)) + 1)
    r = r.select(*by, "key", "feature", "place", xs.alias("x"), F.xxhash64(F.transform("v", lambda e: e["patient_id"])).alias("who"), F.size("v").alias("n"), step.alias("step"), total.alias("total"))
    # neighbours may round to steps a factor of two apart, so both steps are looked up
    places = F.array_distinct(F.flatten(F.transform(F.array(F.col("step"), F.col("step") * 2), lambda s: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.struct(s.alias("s"), (F.floor(F.col("total") / s) + d).alias("at"))))))
    a = r.select(*by, "key", "who", "n", F.col("feature").alias("a"), F.col("place").alias("pa"), F.col("x").alias("xa"), F.explode(places).alias("cell"))
    own = F.array_distinct(F.transform(F.array(F.col("step"), F.col("step") * 2), lambda s: F.struct(s.alias("s"), F.floor(F.col("total") / s).alias("at"))))
    b = r.select(*by, "key", "who", "n", F.col("feature").alias("b"), F.col("place").alias("pb"), F.col("x").alias("xb"), F.explode(own).alias("cell"))
    near = F.forall(F.zip_with("xa", "xb", lambda p, q: F.abs(p - q)), lambda d: d <= atol)
    return a.join(b, [*by, "key", "who", "n", "cell"]).where((F.col("pa") < F.col("pb")) & near).select(*by, "key", "a", "b").distinct()


def greedy_representatives(pairs: DataFrame, registry: DataFrame, by: list[str]) -> DataFrame:
    """O167: (by, feature, representative, ...) of the features that give way: in order of evidence, a feature goes to the best-placed feature that stays and that a pair joins it with. pairs: (by, key, a, b, ...), a before b, only those that pass the rule."""
    place = registry.select(*by, F.col("feature").alias("a"), F.col("place").alias("pa"))
    mine = registry.select(*by, F.col("feature").alias("b"), F.col("place").alias("pb"))
    p = pairs.join(place, [*by, "a"]).join(mine, [*by, "b"])
    types = dict(p.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for b, g in rows.sort_values(["pb", "pa"]).groupby("pb", sort=True):
            stays = g[~g["a"].isin(gone)]
            if len(stays):
                out.append(stays.iloc[0])
                gone.add(stays.iloc[0]["b"])
        return pd.DataFrame(out, columns=rows.columns)

    return p.groupBy(*by, "key").applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in p.columns)).withColumnRenamed("b", "feature").withColumnRenamed("a", "representative").drop("pa", "pb", "key")


def alike(registry: DataFrame, values: DataFrame, by: list[str], key: str, least: float, loss: float, min_n: int = LEAST_N, locations: bool = False, other_summary: bool = False) -> DataFrame:
    """O167: pairs (by, key, a, b, rho, n, oof_loss), a before b in evidence, of features of one key whose Spearman correlation over at least min_n patients is at least `least`, and of which b's metric is at most `loss` above a's. Unparsed features take no part; with `locations` only means and medians do; with `other_summary` only pairs of unlike summaries."""
    r = registry.where(F.col(key).isNotNull())
    if locations:
        r = r.where(F.lower("summary").isin(LOCATIONS))
    r = r.select(*by, F.col(key).alias("key"), "feature", "place", "oof", F.lower(F.trim(F.coalesce("summary", F.lit("")))).alias("summary"))
    several = r.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(*by, "key"))).where("m > 1").drop("m")
    rho = spearman_pairs(values.join(several.select(*by, "key", "feature"), [*by, "feature"]), [*by, "key"], min_n)
    side = lambda x: r.select(*by, "key", F.col("feature").alias(x), F.struct("place", "oof", "summary").alias(f"r{x}"))
    p = rho.join(side("a"), [*by, "key", "a"]).join(side("b"), [*by, "key", "b"])
    first = F.col("ra.place") < F.col("rb.place")
    swap = lambda x, y: F.when(first, x).otherwise(y)
    p = p.select(*by, "key", swap(F.col("a"), F.col("b")).alias("a"), swap(F.col("b"), F.col("a")).alias("b"), "rho", "n", swap(F.col("rb.oof") - F.col("ra.oof"), F.col("ra.oof") - F.col("rb.oof")).alias("oof_loss"), (F.col("ra.summary") != F.col("rb.summary")).alias("unlike"))
    p = p.where((F.col("rho") >= least) & (F.col("oof_loss") <= loss) & ~F.isnan("oof_loss"))
    return (p.where("unlike") if other_summary else p).drop("unlike")


def compress(registry: DataFrame, values: DataFrame, by: list[str], atol: float = TOLERANCE, summary: tuple[float, float] = (SUMMARY_RHO, MOST_LOSS), residual: tuple[float, float] = (RESIDUAL_RHO, MOST_LOSS), min_n: int = LEAST_N) -> DataFrame:
    """O166, O167: each feature's row with rule, representative, rho, n, oof_loss of the pass that it gave way in (null if it stays) and final, the feature that stands for it in the end.

    Three passes, each over what the one before left: equal vectors of one meaning; mean and median of one measure; what else has one meaning.
    The registry has a `place` (evidence_order). Each pass's decisions are written to the shared folder, since the next ones build on them.
    """
    active, decisions = registry, None
    extra = {"rho": "double", "n": "long", "oof_loss": "double"}
    side = lambda x: active.select(*by, F.col("feature").alias(x), F.col("oof").alias(f"o{x}"))
    for rule in ("equal_vectors", "mean_and_median", "same_meaning"):
        if rule == "equal_vectors":
            pairs = near_equal_vectors(active, values, by, atol=atol)
            n = values.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, F.col("feature").alias("a")).agg(F.count(F.lit(1)).alias("n"))
            pairs = pairs.join(n, [*by, "a"]).join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).select(*by, "key", "a", "b", F.lit(1.0).alias("rho"), "n", (F.col("ob") - F.col("oa")).alias("oof_loss"))
        elif rule == "mean_and_median":
            pairs = alike(active, values, by, "summary_key", *summary, min_n, locations=True, other_summary=True)
        else:
            pairs = alike(active, values, by, "exact_key", *residual, min_n)
        pairs = pairs.select(*by, "key", "a", "b", *(F.col(c).cast(t).alias(c) for c, t in extra.items()))
        gone = greedy_representatives(pairs, active, by).select(*by, "feature", F.lit(rule).alias("rule"), "representative", *extra)
        gone = kept(gone, rule)
        active = active.join(gone.select(*by, "feature"), [*by, "feature"], "left_anti")
        decisions = gone if decisions is None else decisions.unionByName(gone)
    out = registry.join(decisions, [*by, "feature"], "left").withColumn("final", F.coalesce("representative", "feature"))
    after = decisions.select(*by, F.col("feature").alias("final"), F.col("representative").alias("next"))
    for _ in range(2):  # a representative may give way in each of the two later passes
        out = out.join(after, [*by, "final"], "left").withColumn("final", F.coalesce("next", "final")).drop("next")
    return out


def parsed_registry(features: DataFrame, parsed: str = "parsed") -> DataFrame:
    """A registry's keys from its parsed names: exact_key, summary_key (all but the summary) and summary; null keys for unparsed names."""
    p = F.col(parsed)
    base = F.to_json(F.struct(p["kind"].alias("kind"), p["subtype"].alias("subtype"), F.transform(p["entities"], lambda e: F.struct(e["role"].alias("role"), e["cell"].alias("cell"), e["state"].alias("state"))).alias("entities"), p["params"].alias("params"), p["compartment"].alias("compartment")))
    return features.withColumns({"exact_key": p["exact_key"], "summary_key": F.when(p["exact_key"].isNotNull(), base), "summary": p["summary"]})


_WORDS = ["tumor", "Tumour", "PanCK", "nk", "cd8", "plasma"]


def _registry(t) -> tuple[DataFrame, DataFrame]:
    """Suppliers' mean, median, least and greatest quantity of a brand's parts, by return flag; brands have names of cells, so that several mean the same, and every other one comes twice, a little apart."""
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand"))
    l = t("lineitem").join(p, "l_partkey").groupBy(F.col("l_returnflag").alias("root"), F.col("l_suppkey").alias("patient_id"), "brand").agg(F.avg("l_quantity").alias("mean"), F.median("l_quantity").alias("median"), F.min("l_quantity").cast("double").alias("min"), F.max("l_quantity").cast("double").alias("max"))
    v = l.unpivot(["root", "patient_id", "brand"], ["mean", "median", "min", "max"], "stat", "value")
    v = v.withColumn("copy", F.explode(F.when(F.col("brand") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("value", F.round("value", 6) + F.col("copy") * 4e-13)
    word = F.array(*(F.lit(w) for w in _WORDS))[F.col("brand") % len(_WORDS)]
    name = F.concat(F.lit("infiltration_"), word, F.lit("__"), F.when(F.col("brand") < 30, "All").otherwise("Tumor"), F.lit("__"), "stat")
    v = v.select("root", "patient_id", F.concat_ws("|", "brand", "stat", "copy").alias("feature"), name.alias("name"), "value")
    v = kept(v, "values")
    r = v.groupBy("root", "feature", "name").agg(F.round(F.stddev_samp("value") / F.avg("value"), 6).alias("oof"), F.count(F.lit(1)).alias("filled"))
    r = grammar.parse_features(r.withColumns({"src": F.lit("phenotype_only"), "grp": F.lit("athena")}), "name", "src", "grp")
    r = parsed_registry(r).select("root", "feature", "name", "oof", "filled", "exact_key", "summary_key", "summary")
    return kept(evidence_order(r, ["root"], [F.desc_nulls_last("oof"), F.desc("filled")]), "registry"), v


_VECTORS = """b AS MATERIALIZED (SELECT l_returnflag AS root, l_suppkey AS patient_id, regexp_extract(p_brand, '(\\d+)', 1)::INT AS brand, avg(l_quantity) AS mean, median(l_quantity) AS median, min(l_quantity)::DOUBLE AS min, max(l_quantity)::DOUBLE AS max FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
), v AS MATERIALIZED (SELECT root, patient_id, brand || '|' || stat || '|' || copy AS feature, brand, stat, round(value, 6) + copy * 4e-13::DOUBLE AS value FROM (UNPIVOT b ON mean, median, min, max INTO NAME stat VALUE value), (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR brand % 2 = 1
), reg AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY root ORDER BY oof DESC NULLS LAST, filled DESC, feature) AS place FROM (SELECT root, feature, CASE WHEN brand < 30 THEN 'All' ELSE 'Tumor' END || CASE WHEN brand % 6 < 3 THEN 0 ELSE brand % 6 END AS measure, stat, round(stddev_samp(value) / avg(value), 6) AS oof, count(*) AS filled FROM v GROUP BY root, feature, brand, stat))"""


@query("o166_exact_duplicates", f"WITH {_VECTORS}, d AS (SELECT a.root, a.feature AS a, b.feature AS b FROM reg x JOIN reg y ON x.root = y.root AND x.measure = y.measure AND x.stat = y.stat AND x.place < y.place AND x.filled = y.filled JOIN v a ON a.root = x.root AND a.feature = x.feature JOIN v b ON b.root = y.root AND b.feature = y.feature AND a.patient_id = b.patient_id GROUP BY a.root, a.feature, b.feature, x.filled HAVING count(*) = x.filled AND max(abs(a.value - b.value)) <= 1e-12::DOUBLE) SELECT root, a, b FROM d")
def _o166(t):
    registry, values = _registry(t)
    return near_equal_vectors(registry, values, ["root"]).select("root", "a", "b")


@query("o167_greedy_compression")
def _o167(t):
    registry, values = _registry(t)
    out = compress(registry, values, ["root"], summary=(0.6, 0.05), residual=(0.3, 0.05), min_n=10)
    return out.select("root", "feature", "place", "rule", "representative", F.round("rho", 9).alias("rho"), "n", F.round("oof_loss", 6).alias("oof_loss"), "final")
