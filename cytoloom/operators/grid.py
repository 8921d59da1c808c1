"""O169: the whole grid of candidate caps and correlation limits, and what each cell's features are supported by.

A cell keeps of each context the features placed up to its cap, and of these those that the greedy pass at its limit keeps. That pass goes in order
of evidence, so what stands below a cap never changes what stands above it: one run a limit, to the greatest cap, holds all caps as its prefixes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import EVIDENCE, query
from ..sources import scratch

# The grid, the quotas of exceptional features and the guardrails.
CAPS, RHOS = list(range(10, 210, 10)), [round(0.85 + 0.01 * i, 2) for i in range(11)]
MOST_PER_PANEL, MOST_PER_COHORT, LEAST_CONTEXTS, TOP_EVIDENCE = 10, 3, 2, 0.95
COUNT_RANGE, LEAST_SUPPORT, MOST_SINGLE = (60, 125), 0.20, 0.40


def kept_at(registry: DataFrame, pairs: DataFrame, by: list[str], rhos: list[float]) -> DataFrame:
    """(by, limit, feature, place) of the features that stay at each limit. registry: (by, feature, place); pairs: (by, key, a, b, rho), features that may stand for each other.

    A feature goes if a better-placed one that stays has at least the limit's correlation with it. A task takes the pairs of one key at one
    limit; features without pairs meet none.
    """
    limits = F.explode(F.array(*map(F.lit, rhos))).alias("limit")
    at = lambda x: registry.select(*by, F.col("feature").alias(x), F.col("place").alias(f"p{x}"))
    p = pairs.where(F.col("rho") >= min(rhos)).join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"])
    first = F.col("pa") < F.col("pb")
    p = p.select(*by, "key", "rho", F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb"), limits).where(F.col("rho") >= F.col("limit"))
    types = dict(p.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for b, g in rows.groupby("pb", sort=True):
            if not g["pa"].isin(gone).all():
                gone[b] = g["b"].iloc[0]
        return pd.DataFrame([(*key[:-1], f) for f in gone.values()], columns=[*by, "limit", "feature"])

    gone = p.groupBy(*by, "limit", "key").applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), "limit double", f"feature {types['b']}"]))
    return registry.select(*by, limits, "feature", "place").join(gone, [*by, "limit", "feature"], "left_anti")


def cells(kept: DataFrame, caps: list[int]) -> DataFrame:
    """A row for each cell (cap, limit) and feature that it keeps, read off the prefixes."""
    return kept.withColumn("cap", F.explode(F.filter(F.array(*map(F.lit, sorted(caps))), lambda c: c >= F.col("place"))))


def support(rows: DataFrame) -> DataFrame:
    """What supports a feature in each cell and panel. rows: (cap, limit, panel, cohort, context, strong, feature, score, oof), a feature of a context once.

    s2: in two cohorts or more. exceptional: in one cohort, in a strong context, and either in LEAST_CONTEXTS contexts or in the top of the
    panel's median scores; of these, in order of contexts, score's percentile, score and metric, MOST_PER_PANEL with MOST_PER_COHORT of a cohort.
    """
    cell = ["cap", "limit", "panel"]
    s = rows.groupBy(*cell, "feature").agg(F.count_distinct("context").alias("n_contexts"), F.count_distinct("cohort").alias("n_cohorts"), F.min("cohort").alias("cohort"), F.coalesce(F.bool_or("strong"), F.lit(False)).alias("strong"), F.median("score").alias("score"), F.max("oof").alias("oof"))
    w = Window.partitionBy(*cell)
    ranked = w.orderBy("score")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*cell, "score"))
    present = F.count("score").over(w)
    nulls = F.count(F.lit(1)).over(w) - present
    percentile = F.when(F.col("score").isNotNull(), (F.rank().over(ranked) - nulls + (ties - 1) / 2) / present)
    s = s.withColumn("percentile", percentile).withColumn("s2", F.col("n_cohorts") >= 2)
    s = s.withColumn("eligible", (F.col("n_cohorts") == 1) & F.col("strong") & ((F.col("n_contexts") >= LEAST_CONTEXTS) | F.coalesce(F.col("percentile") >= TOP_EVIDENCE, F.lit(False))))
    order = [F.desc("n_contexts"), F.desc_nulls_last("percentile"), F.desc_nulls_last("score"), F.desc_nulls_last("oof"), "feature"]
    s = s.withColumn("i", F.row_number().over(Window.partitionBy(*cell, "eligible", "cohort").orderBy(*order)))
    s = s.withColumn("quota", F.col("eligible") & (F.col("i") <= MOST_PER_COHORT)).withColumn("j", F.row_number().over(Window.partitionBy(*cell, "quota").orderBy(*order)))
    s = s.withColumn("exceptional", F.col("quota") & (F.col("j") <= MOST_PER_PANEL))
    return s.withColumn("chosen", F.col("s2") | F.col("exceptional")).drop("i", "j", "quota")


def grid_metrics(rows: DataFrame, supported: DataFrame) -> DataFrame:
    """Figures and guardrails of each cell and panel: records, different features, features in two cohorts, exceptional ones, the greatest share of a cohort in all features and in those of one cohort only."""
    cell, n = ["cap", "limit", "panel"], F.count(F.lit(1))
    total = rows.groupBy(*cell).agg(n.alias("n_records"), F.count_distinct("context").alias("n_contexts"))
    s = supported.groupBy(*cell).agg(n.alias("n_unique"), F.count_if("s2").alias("n_s2"), F.count_if("exceptional").alias("n_exceptional"), F.count_if("chosen").alias("n_chosen"))
    own = rows.select(*cell, "cohort", "feature").distinct().join(supported.select(*cell, "feature", "n_cohorts"), [*cell, "feature"]).groupBy(*cell, "cohort").agg(n.alias("all"), F.count_if(F.col("n_cohorts") == 1).alias("single"))
    most = own.groupBy(*cell).agg(F.max("all").alias("all"), F.max("single").alias("single"))
    m = total.join(s, cell).join(most, cell)
    m = m.select(*cell, "n_contexts", "n_records", "n_unique", "n_s2", "n_exceptional", "n_chosen", (F.col("n_s2") / F.col("n_unique")).alias("support"), (F.col("all") / F.col("n_unique")).alias("coverage"), (F.col("single") / F.col("n_unique")).alias("single"))
    passes = F.col("n_chosen").between(*COUNT_RANGE) & (F.col("support") >= LEAST_SUPPORT) & (F.col("single") <= MOST_SINGLE)
    return m.withColumn("passes", passes).withColumn("distance", F.abs(F.col("n_chosen") - sum(COUNT_RANGE) / 2))


def _candidates(t) -> tuple[DataFrame, DataFrame]:
    """Parts as candidates of their brand and type (a context) in order of evidence; neighbours in price within one stand for each other, the closer the better."""
    e = t("part").select(F.concat_ws("/", "p_brand", "p_type").alias("context"), F.substring("p_brand", -1, 1).alias("cohort"), F.when(F.col("p_size") < 25, "A").otherwise("B").alias("panel"), (F.col("p_partkey") % 211).alias("feature"), (F.col("p_size") % 3 == 0).alias("strong"), F.round("p_retailprice", 2).alias("score"), F.col("p_partkey"))
    e = e.groupBy("panel", "context", "cohort", "feature").agg(F.max("score").alias("score"), F.bool_or("strong").alias("strong"), F.min("p_partkey").alias("least"))
    e = e.withColumn("oof", F.round(F.pmod("score", F.lit(100)) / 100, 4)).withColumn("place", F.row_number().over(Window.partitionBy("panel", "context").orderBy(F.desc("oof"), "feature")))
    nxt = Window.partitionBy("panel", "context").orderBy("score", "feature")
    pairs = e.select("panel", "context", F.lit("all").alias("key"), F.col("feature").alias("a"), F.lead("feature").over(nxt).alias("b"), (1 - (F.lead("score").over(nxt) - F.col("score")) / 100).alias("rho")).where("b IS NOT NULL AND rho > 0")
    return e, pairs.withColumn("rho", F.round("rho", 6))


@query("o169_whole_grid")
def _o169_grid(t):
    """Cells of 20 caps and 11 limits for each panel, with support sets and guardrails."""
    e, pairs = _candidates(t)
    e = scratch.kept(e, "candidates")
    kept = kept_at(e.select("panel", "context", "feature", "place"), pairs, ["panel", "context"], RHOS)
    rows = scratch.kept(cells(kept, CAPS).join(e.drop("place"), ["panel", "context", "feature"]), "cells")
    s = scratch.kept(support(rows), "support")
    return grid_metrics(rows, s).withColumns({c: F.round(c, 9) for c in ("support", "coverage", "single")})


@query("o169_support_sets", f"WITH {EVIDENCE}, e AS (SELECT context, right(context, 1) AS cohort, CASE WHEN transform = 0 THEN 'A' ELSE 'B' END AS panel, feature % 97 AS feature, max(oof) AS oof, max(sd) AS score, bool_or(sd < 0.3) AS strong FROM evidence GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY panel, context ORDER BY oof DESC, feature) AS place FROM e), c AS (SELECT r.*, cap, lim FROM r, (SELECT unnest([10, 20, 40]) AS cap), (SELECT unnest([0.9, 0.95]::DOUBLE[]) AS lim) WHERE place <= cap AND (feature * 7) % 20 / 20.0 <= lim), s AS (SELECT cap, lim, panel, feature, count(DISTINCT context) AS n_contexts, count(DISTINCT cohort) AS n_cohorts, min(cohort) AS cohort, bool_or(strong) AS strong, median(score) AS score, max(oof) AS oof FROM c GROUP BY ALL), p AS (SELECT *, (rank() OVER (PARTITION BY cap, lim, panel ORDER BY score) + (count(*) OVER (PARTITION BY cap, lim, panel, score) - 1) / 2.0) / count(*) OVER (PARTITION BY cap, lim, panel) AS percentile FROM s), q AS (SELECT *, n_cohorts = 1 AND strong AND (n_contexts >= 2 OR percentile >= 0.95) AS eligible FROM p), x AS (SELECT *, eligible AND row_number() OVER (PARTITION BY cap, lim, panel, eligible, cohort ORDER BY n_contexts DESC, percentile DESC, score DESC, oof DESC, feature) <= 3 AS quota FROM q), y AS (SELECT *, quota AND row_number() OVER (PARTITION BY cap, lim, panel, quota ORDER BY n_contexts DESC, percentile DESC, score DESC, oof DESC, feature) <= 10 AS exceptional FROM x), o AS (SELECT c.cap, c.lim, c.panel, c.cohort, count(DISTINCT c.feature) AS a, count(DISTINCT c.feature) FILTER (WHERE n_cohorts = 1) AS b FROM c JOIN y ON c.cap = y.cap AND c.lim = y.lim AND c.panel = y.panel AND c.feature = y.feature GROUP BY ALL), m AS (SELECT cap, lim, panel, max(a) AS a, max(b) AS b FROM o GROUP BY ALL), z AS (SELECT cap, lim, panel, count(*) AS n_unique, count(*) FILTER (WHERE n_cohorts >= 2) AS n_s2, count(*) FILTER (WHERE exceptional) AS n_exceptional, count(*) FILTER (WHERE exceptional OR n_cohorts >= 2) AS n_chosen FROM y GROUP BY ALL), t AS (SELECT cap, lim, panel, count(*) AS n_records, count(DISTINCT context) AS n_contexts FROM c GROUP BY ALL) SELECT cap::INT AS cap, lim AS \"limit\", panel, n_contexts, n_records, n_unique, n_s2, n_exceptional, n_chosen, round(n_s2 / n_unique, 9) AS support, round(a / n_unique, 9) AS coverage, round(b / n_unique, 9) AS single, n_chosen BETWEEN 60 AND 125 AND n_s2 / n_unique >= 0.2 AND b / n_unique <= 0.4 AS passes, abs(n_chosen - 92.5)::DOUBLE AS distance FROM z JOIN m USING (cap, lim, panel) JOIN t USING (cap, lim, panel)")
def _o169_support(t):
    e = t.evidence().groupBy("context", F.right("context", F.lit(1)).alias("cohort"), F.when(F.col("transform") == 0, "A").otherwise("B").alias("panel"), (F.col("feature") % 97).alias("feature")).agg(F.max("oof").alias("oof"), F.max("sd").alias("score"), F.bool_or(F.col("sd") < 0.3).alias("strong"))
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("panel", "context").orderBy(F.desc("oof"), "feature")))
    rows = cells(e.withColumn("limit", F.explode(F.array(F.lit(0.9), F.lit(0.95)))), [10, 20, 40]).where((F.col("feature") * 7) % 20 / 20.0 <= F.col("limit"))
    return grid_metrics(rows, support(rows)).withColumns({c: F.round(c, 9) for c in ("support", "coverage", "single")})
