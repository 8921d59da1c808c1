"""Novelty of ranked candidates and what each further one adds: O163, O165.

Candidates stand in order of evidence (a registry with `place`); pairs hold their correlations. Only pairs above the limit ever meet in a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from .compression import _ROOTS, _pairs
from .grid import kept_at
from .microcompression import evidence_order
from .programs import recommended_caps

LIMIT, DEEPEST = 0.15, 50


def novelty(registry: DataFrame, pairs: DataFrame, by: list[str], limit: float) -> DataFrame:
    """O163: adds `novel`: in order of evidence, a candidate is novel if its |rho| with every novel one before it is under the limit; an unknown rho counts as under it."""
    high = pairs.select(*by, F.lit("all").alias("key"), "a", "b", F.abs("rho").alias("rho"))
    kept = kept_at(registry.select(*by, "feature", "place"), high, by, [limit]).select(*by, "feature", F.lit(True).alias("novel"))
    return registry.join(kept, [*by, "feature"], "left").withColumn("novel", F.coalesce("novel", F.lit(False)))


def depth_diagnostics(registry: DataFrame, pairs: DataFrame, by: list[str], limit: float, most: int = DEEPEST) -> DataFrame:
    """O165: for each depth up to `most`: pairs known and redundant (|rho| of the limit at least) among the candidates so far, candidates in redundant pairs, components that these make, novel candidates, their share, and whether the last one is novel.

    A pair counts from the depth of its later candidate on, so all figures are running sums of what each depth adds.
    """
    r = registry.where(F.col("place") <= most).select(*by, "feature", "place")
    at = lambda x: r.select(*by, F.col("feature").alias(x), F.col("place").alias(f"p{x}"))
    p = pairs.where(F.col("rho").isNotNull()).join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]).withColumn("depth", F.greatest("pa", "pb")).withColumn("high", F.abs("rho") >= limit)
    added = p.groupBy(*by, "depth").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("high").alias("n_redundant"))
    high = p.where("high").select(*by, "pa", "pb", "depth")
    joined = high.select(*by, F.explode(F.array("pa", "pb")).alias("i"), "depth").groupBy(*by, "i").agg(F.min("depth").alias("depth")).groupBy(*by, "depth").agg(F.count(F.lit(1)).alias("n_involved"))
    types = dict(high.dtypes)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for d, a, b in rows.sort_values("depth")[["depth", "pa", "pb"]].itertuples(index=False):
            a, b = root(a), root(b)
            if a != b:
                parent[b] = a
                out.append((*key, d))
        return pd.DataFrame(out, columns=[*by, "depth"])

    merged = high.groupBy(*by).applyInPandas(merge, ", ".join([*(f"{c} {types[c]}" for c in by), "depth int"])).groupBy(*by, "depth").agg(F.count(F.lit(1)).alias("merges"))
    flags = novelty(registry, pairs, by, limit).where(F.col("place") <= most).select(*by, F.col("place").alias("depth"), "novel")
    d = flags
    for x in (added, joined, merged):
        d = d.join(x, [*by, "depth"], "left")
    w = Window.partitionBy(*by).orderBy("depth")
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    new = run(F.col("novel").cast("int"))
    return d.select(*by, "depth", run(F.col("n_pairs")).alias("n_pairs"), run(F.col("n_redundant")).alias("n_redundant"), run(F.col("n_involved")).alias("n_involved"), (F.col("depth") - run(F.col("merges"))).alias("n_components"), new.alias("n_novel"), (new / F.col("depth")).alias("novelty_yield"), F.col("novel").alias("is_novel"))


def ranked(t) -> DataFrame:
    """Features of each root in order of their coefficient of variation over patients."""
    f = t.features().select(F.substring_index("feature", "_", 1).alias("root"), "feature", F.round("value", 6).alias("value"))
    r = f.groupBy("root", "feature").agg(F.round(F.stddev_samp("value") / F.avg("value"), 6).alias("oof"))
    return evidence_order(r, ["root"], [F.desc_nulls_last("oof")])


_RANKED = f"""{_ROOTS}, ord AS MATERIALIZED (SELECT root, feature, row_number() OVER (PARTITION BY root ORDER BY oof DESC NULLS LAST, feature) AS place FROM (SELECT root, feature, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS oof FROM ff GROUP BY ALL)
), pr AS MATERIALIZED (SELECT rho.root, least(x.place, y.place) AS lo, greatest(x.place, y.place) AS hi, abs(rho) >= {LIMIT}::DOUBLE AS high FROM rho JOIN ord x ON x.root = rho.root AND x.feature = a JOIN ord y ON y.root = rho.root AND y.feature = b WHERE rho IS NOT NULL
), conf AS MATERIALIZED (SELECT o.root, place, feature, coalesce(list(lo) FILTER (WHERE high), []) AS before FROM ord o LEFT JOIN pr ON pr.root = o.root AND hi = place GROUP BY ALL
), acc AS (SELECT DISTINCT root, 0::BIGINT AS place, []::BIGINT[] AS got FROM ord UNION ALL SELECT acc.root, conf.place, CASE WHEN list_has_any(got, before) THEN got ELSE list_append(got, conf.place) END FROM acc JOIN conf ON conf.root = acc.root AND conf.place = acc.place + 1
), novel AS MATERIALIZED (SELECT root, place, list_contains(got, place) AS novel, len(got) AS n_novel FROM acc WHERE place > 0)"""
_DEPTHS = f"""{_RANKED}, k AS (SELECT root, place AS k FROM ord WHERE place <= {DEEPEST}
), c AS (SELECT k.root, k.k, o.place AS x, o.place AS m FROM k JOIN ord o ON o.root = k.root AND o.place <= k.k UNION SELECT c.root, c.k, e.y, c.m FROM c JOIN (SELECT root, lo AS x, hi AS y, hi FROM pr WHERE high UNION ALL SELECT root, hi, lo, hi FROM pr WHERE high) e ON e.root = c.root AND e.x = c.x AND e.hi <= c.k WHERE c.m < e.y
), parts AS (SELECT root, k, count(DISTINCT m) AS n_components FROM (SELECT root, k, x, min(m) AS m FROM c GROUP BY ALL) GROUP BY ALL
), d AS (SELECT k.root, k.k::INT AS depth, (SELECT count(*) FROM pr WHERE pr.root = k.root AND hi <= k.k) AS n_pairs, (SELECT count(*) FROM pr WHERE high AND pr.root = k.root AND hi <= k.k) AS n_redundant, (SELECT count(DISTINCT i) FROM (SELECT root, hi, unnest([lo, hi]) AS i FROM pr WHERE high) u WHERE u.root = k.root AND u.hi <= k.k) AS n_involved, n_components, n_novel, n_novel / k.k::DOUBLE AS novelty_yield, novel AS is_novel FROM k JOIN parts USING (root, k) JOIN novel n ON n.root = k.root AND n.place = k.k)"""


@query("o163_greedy_novelty", f"WITH RECURSIVE {_RANKED} SELECT o.root, feature, o.place::INT AS place, novel FROM ord o JOIN novel n ON n.root = o.root AND n.place = o.place")
def _o163(t):
    return novelty(ranked(t), _pairs(t), ["root"], LIMIT).select("root", "feature", "place", "novel")


@query("o165_depth_diagnostics", f"WITH RECURSIVE {_DEPTHS} SELECT root, depth, n_pairs, n_redundant, n_involved, n_components, n_novel, round(novelty_yield, 9) AS novelty_yield, is_novel FROM d")
def _o165(t):
    return depth_diagnostics(ranked(t), _pairs(t), ["root"], LIMIT).withColumn("novelty_yield", F.round("novelty_yield", 9))


_BEST = {"strict": 0.90, "balanced": 0.80, "permissive": 0.70}


@query("o165_cap_recommendation", f"""WITH RECURSIVE {_DEPTHS}, w AS (SELECT *, sum(is_novel::INT) OVER (PARTITION BY root ORDER BY depth ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, sum(is_novel::INT) OVER (PARTITION BY root ORDER BY depth ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a, max(depth) OVER (PARTITION BY root) AS deepest FROM d
), g AS (SELECT root, {", ".join(f"coalesce(arg_min(depth, (-n_novel, depth)) FILTER (WHERE novelty_yield >= {y}::DOUBLE), 1) AS {p}" for p, y in _BEST.items())}, min(depth) FILTER (WHERE depth >= 5 AND depth + 5 <= deepest AND b <= 2 AND a <= 2) - 4 AS elbow, max(depth) AS deepest FROM w GROUP BY root
) SELECT *, least(balanced, elbow) AS recommended, least(balanced, elbow) >= deepest AS at_boundary FROM g""")
def _o165b(t):
    return recommended_caps(depth_diagnostics(ranked(t), _pairs(t), ["root"], LIMIT), "root")
