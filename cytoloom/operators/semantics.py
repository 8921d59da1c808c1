"""What features mean: similarity of parsed names, cohesion of modules in meaning and over cohorts, matched modules. O127, O178, O187."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feature_grammar as grammar
from ..plans.registry import FEATURES, query
from ..sources.scratch import kept
from .aggregates import spearman_pairs

# What tells features of a source apart, and the weights of the parts of similarity.
STATE_AWARE, BY_STATE, BY_COMPARTMENT = ["AR_state", "compartment_state"], ["AR_checkpoint_state"], ["compartment", "compartment_state"]
IDENTITIES = {"immune_cell": "immune", "tumor_cell": "tumor", "stromal_cell": "stroma"}
METRIC_WEIGHTS = {"family": 0.60, "summary": 0.20, "params": 0.20}
TISSUE_WEIGHTS = {"primitive": 0.75, "tissue": 0.25}
ALL_WEIGHTS = {"primitive": 0.55, "tissue": 0.20, "metric": 0.25}
LAYERS = ["primitive", "tissue", "family", "summary", "params"]


def tokens(p: Column) -> Column:
    """O127: the tokens of a parsed name by layer: who plays which role in which state, where, what is measured, how it is summed up, with which parameters."""
    src = p["source"]

    def of(e: Column) -> Column:
        cell = F.when(src.isin(BY_COMPARTMENT), F.coalesce(F.create_map(*(F.lit(x) for kv in IDENTITIES.items() for x in kv))[e["cell"]], e["cell"])).otherwise(e["cell"])
        who, state = F.concat(e["role"], F.lit(":identity:"), cell), F.concat(e["role"], F.lit(":state:"), e["state"])
        return F.when(src.isin(BY_STATE), F.array(state)).when(src.isin(STATE_AWARE), F.array(who, state)).otherwise(F.array(who))

    some = lambda *c: F.array_distinct(F.filter(F.array(*c), lambda x: x.isNotNull()))
    primitive = F.array_distinct(F.filter(F.flatten(F.transform(p["entities"], of)), lambda x: x.isNotNull()))
    named = lambda k, c: F.concat(F.lit(f"{k}:"), F.nullif(F.trim(c), F.lit("")))
    return F.struct(
        primitive.alias("primitive"), some(named("tissue", p["compartment"])).alias("tissue"), some(F.concat(F.lit("group:"), F.coalesce(p["group"], F.lit(""))), F.concat(F.lit("type:"), p["kind"]), F.concat(F.lit("subtype:"), p["subtype"])).alias("family"),
        some(named("summary", F.lower(p["summary"]))).alias("summary"), F.transform(F.map_entries(p["params"]), lambda m: F.concat_ws("=", m["key"], m["value"])).alias("params"),
    )


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """O083, O127: mean of the parts that are present, by weights that are made to add up to one over these; 0 if none is."""
    total = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(sum((w * F.coalesce(parts[k], F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)), total), F.lit(0.0))


def ontology_similarity(features: DataFrame, by: list[str]) -> DataFrame:
    """O127: (by, a, b, primitive, tissue, family, summary, params, metric, tissue_aware, metric_aware) of the pairs a < b within a key of `by` that share any token; all others have similarity 0 throughout.

    features: (by, feature, parsed), a row a feature. Pairs come from an inverted index, token by token, never from a cross join. A layer is
    Jaccard's index of its tokens; tissue, summary and params are null where neither has any. metric is of family, summary and params;
    tissue_aware of primitive and tissue; metric_aware of primitive, tissue and metric: weighted means over the parts that are not null.
    """
    t = features.select(*by, "feature", tokens(F.col("parsed")).alias("t"))
    sizes = t.select(*by, "feature", F.struct(*(F.size(f"t.{x}").alias(x) for x in LAYERS)).alias("size"))
    layers = F.array(*(F.struct(F.lit(i).alias("layer"), F.col(f"t.{x}").alias("tokens")) for i, x in enumerate(LAYERS)))
    index = t.select(*by, "feature", F.explode(layers).alias("l")).select(*by, "feature", "l.layer", F.explode("l.tokens").alias("token"))
    a, b = index.withColumnRenamed("feature", "a"), index.withColumnRenamed("feature", "b")
    shared = a.join(b, [*by, "layer", "token"]).where("a < b").groupBy(*by, "a", "b").agg(*(F.count_if(F.col("layer") == i).alias(f"n_{x}") for i, x in enumerate(LAYERS)))
    own = lambda x: sizes.withColumnRenamed("feature", x).withColumnRenamed("size", f"s_{x}")
    both = shared.join(own("a"), [*by, "a"]).join(own("b"), [*by, "b"])

    def index_of(x: str) -> Column:
        n = F.col(f"n_{x}")
        j = F.try_divide(n, F.col(f"s_a.{x}") + F.col(f"s_b.{x}") - n)
        return F.coalesce(j, F.lit(0.0)) if x in ("primitive", "family") else j

    both = both.select(*by, "a", "b", *(index_of(x).alias(x) for x in LAYERS))
    parts = {x: F.col(x) for x in LAYERS}
    both = both.withColumn("metric", weighted(parts, METRIC_WEIGHTS))
    return both.withColumn("tissue_aware", weighted(parts, TISSUE_WEIGHTS)).withColumn("metric_aware", weighted(parts | {"metric": F.col("metric")}, ALL_WEIGHTS))


def within(pairs: DataFrame, labels: DataFrame, by: list[str], k: str = "k") -> DataFrame:
    """Pairs (by, a, b, ...) whose features have one cluster, for each K; labels: (by, k, feature, cluster)."""
    own = lambda x: labels.select(*by, k, F.col("feature").alias(x), "cluster")
    return pairs.join(own("a"), [*by, "a"]).join(own("b"), [*by, k, "b", "cluster"])


def cohort_reproducibility(pairs: DataFrame, labels: DataFrame, by: list[str], k: str = "k") -> DataFrame:
    """O178: for each key and K, how modules hold together in single cohorts. pairs: (by, cohort, a, b, rho).

    From the mean rho of the pairs within a module and cohort (null rho left out): its median and lower quartile, the share that is positive, the
    share of modules that are positive in all cohorts they have pairs in, and the median over modules of the sd over cohorts (0 for one).
    """
    m = within(pairs.where(F.col("rho").isNotNull()), labels, by, k).groupBy(*by, k, "cluster", "cohort").agg(F.avg("rho").alias("rho"))
    module = m.groupBy(*by, k, "cluster").agg(F.collect_list("rho").alias("r"), F.bool_and(F.col("rho") > 0).alias("all"), F.coalesce(F.stddev_samp("rho"), F.lit(0.0)).alias("sd"))
    rows = module.select(*by, k, "all", "sd", F.explode("r").alias("rho"), F.size("r").alias("n"))
    first = rows.groupBy(*by, k).agg(F.median("rho").alias("median_rho"), F.percentile("rho", F.lit(0.25)).alias("q25_rho"), F.avg((F.col("rho") > 0).cast("double")).alias("share_positive"))
    second = module.groupBy(*by, k).agg(F.avg(F.col("all").cast("double")).alias("share_modules_positive"), F.median("sd").alias("median_sd"))
    return first.join(second, [*by, k])


def semantic_coherence(similar: DataFrame, labels: DataFrame, by: list[str], value: str, k: str = "k") -> DataFrame:
    """O178: (by, k, pairs_within, raw, null_mean, enrichment): mean similarity of the pairs within modules, of all pairs (what modules of these sizes have by chance), and their difference.

    similar: (by, a, b, value), pairs that are missing being 0, so that only sums and numbers of pairs are needed.
    """
    sizes = labels.groupBy(*by, k, "cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.groupBy(*by, k).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs_within"), F.sum("n").alias("n"))
    total = similar.groupBy(*by).agg(F.sum(value).alias("total"))
    inside = within(similar, labels, by, k).groupBy(*by, k).agg(F.sum(value).alias("inside"))
    out = pairs.join(total, by, "left").join(inside, [*by, k], "left")
    raw = F.try_divide(F.coalesce("inside", F.lit(0.0)), F.col("pairs_within"))
    null = F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("n") * (F.col("n") - 1) / 2)
    return out.select(*by, k, "pairs_within", raw.alias("raw"), null.alias("null_mean"), (raw - null).alias("enrichment"))


def coherence_null(similar: DataFrame, labels: DataFrame, by: list[str], value: str, k: str = "k", n_perm: int = 100, seed: int = 1, blocks: int = 8) -> DataFrame:
    """O178: (by, k, null_average, null_sd, z, p): raw coherence against permutations of the labels over the features, which keep the modules' sizes.

    A permutation's generator is seeded by its number, its key and K, so the figures are the same for any number of blocks. A task takes one key's
    pairs and labels and a block of the permutations: memory follows the pairs of one key's features that share a token.
    """
    own = labels.groupBy(*by, k).agg(F.sort_array(F.collect_list(F.struct("feature", "cluster"))).alias("l")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(k).alias("k"), "l"))).alias("ks"))
    share = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    type_of = dict(labels.dtypes)

    def run(key: tuple, pairs: pd.DataFrame, lab: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ks in lab["ks"]:
            for x in ks:
                names = [r["feature"] for r in x["l"]]
                at = {n: i for i, n in enumerate(names)}
                cluster = np.unique([r["cluster"] for r in x["l"]], return_inverse=True)[1]
                size = np.bincount(cluster).astype(float)
                count = (size * (size - 1) / 2).sum()
                has = pairs["a"].isin(at) & pairs["b"].isin(at) if len(pairs) else []
                a, b, v = ([], [], []) if not len(pairs) else (pairs["a"][has].map(at).to_numpy(int), pairs["b"][has].map(at).to_numpy(int), pairs[value][has].to_numpy(float))
                mean = lambda c: float((np.asarray(v) * (c[a] == c[b])).sum() / count) if len(v) else 0.0  # noqa: B023, E731
                if not count:
                    continue
                raw = mean(cluster)
                for i in range(int(key[-1]), n_perm, blocks):
                    r = np.random.default_rng([seed, i, zlib.crc32("|".join(map(str, (*key[:-1], x["k"]))).encode())])
                    null = mean(r.permutation(cluster))
                    out.append((*key[:-1], x["k"], null, int(null >= raw - 1e-12)))
        return pd.DataFrame(out, columns=[*by, k, "null", "ge"])

    schema = ", ".join([*(f"{c} {type_of[c]}" for c in by), f"{k} {type_of[k]}", "null double", "ge int"])
    each = similar.select(*by, "a", "b", value, share).groupBy(*by, "block").cogroup(own.select("*", share).groupBy(*by, "block")).applyInPandas(run, schema)
    drawn = each.groupBy(*by, k).agg(F.avg("null").alias("null_average"), F.stddev_samp("null").alias("null_sd"), F.sum("ge").alias("ge"), F.count(F.lit(1)).alias("n"))
    raw = semantic_coherence(similar, labels, by, value, k).select(*by, k, "raw")
    z = F.when(F.col("null_sd") > 1e-12, (F.col("raw") - F.col("null_average")) / F.col("null_sd"))
    return drawn.join(raw, [*by, k]).select(*by, k, "null_average", "null_sd", z.alias("z"), ((1 + F.col("ge")) / (F.col("n") + 1)).alias("p"))


def assign(gain: np.ndarray) -> list[int]:
    """O187: for each row the column that it gets, -1 for none, so that the sum of gains is greatest; every row or every column gets one. Shortest augmenting paths with potentials, row by row, in O(rows^2 x columns)."""
    rows, cols = gain.shape
    if rows > cols:
        back = assign(gain.T)
        out = [-1] * rows
        for c, r in enumerate(back):
            out[r] = c
        return out
    cost = gain.max(initial=0.0) - gain
    of = np.full(cols, -1)  # the row that has a column
    u, v = np.zeros(rows), np.zeros(cols)
    for r in range(rows):
        dist, via, done = cost[r] - u[r] - v, np.full(cols, -1), np.zeros(cols, bool)
        while True:
            j = int(np.argmin(np.where(done, np.inf, dist)))
            done[j] = True
            if of[j] < 0:
                break
            i = of[j]
            through = dist[j] + cost[i] - u[i] - v
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], j
        end = dist[j]
        for c in np.flatnonzero(done):
            if c != j:
                u[of[c]] += end - dist[c]
                v[c] -= end - dist[c]
        u[r] += end
        while via[j] >= 0:
            of[j] = of[via[j]]
            j = int(via[j])
        of[j] = r
    out = [-1] * rows
    for c, r in enumerate(of):
        if r >= 0:
            out[r] = c
    return out


def matched_modules(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """O187: (by, n_shared, ari, mean_jaccard, median_jaccard, min_jaccard, n_matched): two clusterings (by, item, cluster) of the items that both have.

    Modules are paired so that the sum of Jaccard's indexes is greatest; the others of the side that has more get none. Of an item's rows in one
    clustering that of the least cluster counts. Fewer than three shared items give nulls and 0. Only counts of modules' overlaps meet in a task.
    """
    one = lambda df, c: df.where("item IS NOT NULL AND cluster IS NOT NULL").groupBy(*by, "item").agg(F.min("cluster").alias(c))
    n = one(a, "ca").join(one(b, "cb"), [*by, "item"]).groupBy(*by, "ca", "cb").agg(F.count(F.lit(1)).alias("n"))
    na, nb = n.groupBy(*by, "ca").agg(F.sum("n").alias("na")), n.groupBy(*by, "cb").agg(F.sum("n").alias("nb"))
    overlap = n.join(na, [*by, "ca"]).join(nb, [*by, "cb"])
    types = dict(overlap.dtypes)

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        total = int(p["n"].sum())
        if total < 3:
            return pd.DataFrame([(*key, total, None, None, None, None, 0)], columns=names)
        two = lambda x: float((x.astype(float) * (x - 1) / 2).sum())
        rows, cols = np.unique(p["ca"], return_inverse=True), np.unique(p["cb"], return_inverse=True)
        both, left, right = two(p["n"]), two(p.drop_duplicates("ca")["na"]), two(p.drop_duplicates("cb")["nb"])
        chance = left * right / (total * (total - 1) / 2)
        ari = 1.0 if (left + right) / 2 == chance else (both - chance) / ((left + right) / 2 - chance)
        j = np.zeros((len(rows[0]), len(cols[0])))
        j[rows[1], cols[1]] = p["n"] / (p["na"] + p["nb"] - p["n"])
        m = np.array([j[r, c] for r, c in enumerate(assign(j)) if c >= 0])
        return pd.DataFrame([(*key, total, ari, m.mean(), np.median(m), m.min(), len(m))], columns=names)

    names = [*by, "n_shared", "ari", "mean_jaccard", "median_jaccard", "min_jaccard", "n_matched"]
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "n_shared long, ari double, mean_jaccard double, median_jaccard double, min_jaccard double, n_matched int"])
    return overlap.groupBy(*by).applyInPandas(run, schema)


_ID = "concat_ws('|', source, grp, kind, subtype, entities, params, coalesce(compartment, '-'), coalesce(summary, '-'))"
_ONTOLOGY = f"""{grammar._said()}, feats AS MATERIALIZED (
    SELECT {_ID} AS feature, source AS root, grp, kind, subtype, summary, compartment, entities, params, min(p_partkey)::BIGINT AS number FROM said WHERE kind IS NOT NULL GROUP BY ALL
), ents AS (
    SELECT feature, root, string_split(e, '=')[1] AS role, string_split(string_split(e, '=')[2], '/')[1] AS cell, string_split(string_split(e, '=')[2], '/')[2] AS state
    FROM (SELECT feature, root, unnest(string_split(entities, ';')) AS e FROM feats WHERE entities <> '')
), prim AS (
    SELECT feature, list(DISTINCT tok) AS primitive FROM (
        SELECT feature, role || ':identity:' || CASE WHEN root IN ('compartment', 'compartment_state') THEN CASE cell WHEN 'immune_cell' THEN 'immune' WHEN 'tumor_cell' THEN 'tumor' WHEN 'stromal_cell' THEN 'stroma' ELSE cell END ELSE cell END AS tok FROM ents WHERE cell <> '-' AND root <> 'AR_checkpoint_state'
        UNION ALL SELECT feature, role || ':state:' || state FROM ents WHERE state <> '-' AND root IN ('AR_state', 'compartment_state', 'AR_checkpoint_state')) GROUP BY feature
), toks AS MATERIALIZED (
    SELECT feature, root, number, coalesce(primitive, []) AS primitive, CASE WHEN compartment IS NULL THEN [] ELSE [compartment] END AS tissue, ['g' || grp, 't' || kind, 's' || subtype] AS family,
        CASE WHEN summary IS NULL THEN [] ELSE [lower(summary)] END AS summary, CASE WHEN params = '' THEN [] ELSE string_split(params, ';') END AS params FROM feats LEFT JOIN prim USING (feature)
), layers AS (
    SELECT root, a, b, coalesce(pn / nullif(pu, 0)::DOUBLE, 0) AS primitive, tn / nullif(tu, 0)::DOUBLE AS tissue, coalesce(fn / nullif(fu, 0)::DOUBLE, 0) AS family, sn / nullif(su, 0)::DOUBLE AS summary, qn / nullif(qu, 0)::DOUBLE AS params FROM (
        SELECT x.root, x.feature AS a, y.feature AS b, {", ".join(f"len(list_intersect(x.{c}, y.{c})) AS {k}n, len(x.{c}) + len(y.{c}) - len(list_intersect(x.{c}, y.{c})) AS {k}u" for k, c in zip("ptfsq", LAYERS, strict=True))}
        FROM toks x JOIN toks y ON x.root = y.root AND x.feature < y.feature)
), sims AS MATERIALIZED (
    SELECT *, (0.75::DOUBLE * primitive + 0.25::DOUBLE * coalesce(tissue, 0)) / (0.75::DOUBLE + CASE WHEN tissue IS NULL THEN 0 ELSE 0.25::DOUBLE END) AS tissue_aware,
        (0.55::DOUBLE * primitive + 0.2::DOUBLE * coalesce(tissue, 0) + 0.25::DOUBLE * metric) / (0.8::DOUBLE + CASE WHEN tissue IS NULL THEN 0 ELSE 0.2::DOUBLE END) AS metric_aware
    FROM (SELECT *, (0.6::DOUBLE * family + 0.2::DOUBLE * coalesce(summary, 0) + 0.2::DOUBLE * coalesce(params, 0)) / (0.6::DOUBLE + CASE WHEN summary IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN params IS NULL THEN 0 ELSE 0.2::DOUBLE END) AS metric FROM layers)
)"""


def _features(t) -> DataFrame:
    """The parsed names of parts, once for each meaning; number: the least part that has it."""
    p = grammar.parse_features(grammar.planted_once(t("part")), "name", "src", "grp").where("parsed.kind IS NOT NULL")
    o = F.col("parsed")
    feature = F.concat_ws("|", o["source"], o["group"], o["kind"], o["subtype"], grammar._entities(o), grammar._params(o), F.coalesce(o["compartment"], F.lit("-")), F.coalesce(o["summary"], F.lit("-")))
    return kept(p.groupBy(o["source"].alias("root"), feature.alias("feature")).agg(F.min("p_partkey").cast("long").alias("number"), F.first("parsed").alias("parsed")), "features")


@query("o127_ontology_similarity", f"{_ONTOLOGY}, two AS (SELECT root, a AS feature, primitive, metric, tissue_aware, metric_aware FROM sims UNION ALL SELECT root, b, primitive, metric, tissue_aware, metric_aware FROM sims) SELECT root, feature, count(*) AS near, round(sum(primitive), 6) AS primitive, round(sum(metric), 6) AS metric, round(sum(tissue_aware), 6) AS tissue_aware, round(sum(metric_aware), 6) AS metric_aware, round(max(metric_aware), 6) AS nearest FROM two WHERE metric_aware > 0 GROUP BY ALL")
def _o127(t):
    """Of each feature, the features that it resembles, summed up over the whole similarity table."""
    s = ontology_similarity(_features(t), ["root"])
    sums = ["primitive", "metric", "tissue_aware", "metric_aware"]
    two = s.select("root", F.col("a").alias("feature"), *sums).unionByName(s.select("root", F.col("b").alias("feature"), *sums)).where("metric_aware > 0")
    return two.groupBy("root", "feature").agg(F.count(F.lit(1)).alias("near"), *(F.round(F.sum(c), 6).alias(c) for c in sums), F.round(F.max("metric_aware"), 6).alias("nearest"))


def _modules(features: DataFrame) -> DataFrame:
    """Labels of the parsed names for K of 2 to 6: the least part's key modulo K."""
    return features.select("root", "feature", F.explode(F.sequence(F.lit(2), F.lit(6))).alias("k"), "number").select("root", "feature", "k", (F.col("number") % F.col("k")).alias("cluster"))


@query("o178_semantic_coherence", f"{_ONTOLOGY}, lab AS (SELECT root, feature, k, number % k AS cluster FROM toks, (SELECT unnest(range(2, 7)) AS k)), n AS (SELECT root, k, sum(n * (n - 1) / 2)::BIGINT AS pairs_within, sum(n) AS n FROM (SELECT root, k, cluster, count(*) AS n FROM lab GROUP BY ALL) GROUP BY ALL), i AS (SELECT root, x.k, sum(metric_aware) AS inside FROM sims JOIN lab x USING (root) JOIN lab y USING (root) WHERE x.feature = a AND y.feature = b AND x.k = y.k AND x.cluster = y.cluster GROUP BY ALL), s AS (SELECT root, sum(metric_aware) AS total FROM sims GROUP BY root) SELECT n.root, n.k, pairs_within, round(coalesce(inside, 0) / nullif(pairs_within, 0), 6) AS raw, round(coalesce(total, 0) / nullif(n * (n - 1) / 2, 0), 6) AS null_mean, round(coalesce(inside, 0) / nullif(pairs_within, 0) - coalesce(total, 0) / nullif(n * (n - 1) / 2, 0), 6) AS enrichment FROM n LEFT JOIN i ON n.root = i.root AND n.k = i.k LEFT JOIN s ON n.root = s.root")
def _o178_coherence(t):
    f = _features(t)
    return semantic_coherence(ontology_similarity(f, ["root"]), _modules(f), ["root"], "metric_aware").select("root", "k", "pairs_within", *(F.round(c, 6).alias(c) for c in ("raw", "null_mean", "enrichment")))


@query("o178_coherence_null")
def _o178_null(t):
    f = _features(t)
    return coherence_null(kept(ontology_similarity(f, ["root"]), "similarity"), _modules(f), ["root"], "metric_aware")


@query("o178_cohort_reproducibility", f"WITH {FEATURES}, c AS (SELECT s_suppkey AS patient_id, s_nationkey % 3 AS cohort FROM supplier), ff AS (SELECT patient_id, feature, string_split(feature, '_')[1] AS root, round(value, 6) AS value, cohort FROM features JOIN c USING (patient_id)), j AS (SELECT a.cohort, a.root, a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb FROM ff a JOIN ff b ON a.patient_id = b.patient_id AND a.root = b.root AND a.feature < b.feature), r AS (SELECT *, rank() OVER (PARTITION BY cohort, a, b ORDER BY va) + (count(*) OVER (PARTITION BY cohort, a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cohort, a, b ORDER BY vb) + (count(*) OVER (PARTITION BY cohort, a, b, vb) - 1) / 2.0 AS rb FROM j), p AS (SELECT cohort, root, a, b, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 9) AS rho FROM r GROUP BY ALL HAVING count(*) >= 5), lab AS (SELECT feature, k, right(feature, 1)::INT % k AS cluster FROM (SELECT DISTINCT feature FROM features), (SELECT unnest(range(2, 6)) AS k)), m AS (SELECT root, x.k, x.cluster, cohort, avg(rho) AS rho FROM p JOIN lab x ON x.feature = a JOIN lab y ON y.feature = b AND x.k = y.k AND x.cluster = y.cluster WHERE rho IS NOT NULL GROUP BY ALL), o AS (SELECT root, k, cluster, bool_and(rho > 0) AS positive, coalesce(stddev_samp(rho), 0) AS sd FROM m GROUP BY ALL), o2 AS (SELECT root, k, avg(positive::INT) AS share_modules_positive, median(sd) AS median_sd FROM o GROUP BY ALL) SELECT root, k, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.25), 6) AS q25_rho, round(avg((rho > 0)::INT), 6) AS share_positive, round(any_value(share_modules_positive), 6) AS share_modules_positive, round(any_value(median_sd), 6) AS median_sd FROM m JOIN o2 USING (root, k) GROUP BY ALL")
def _o178_cohorts(t):
    c = t("supplier").select(F.col("s_suppkey").alias("patient_id"), (F.col("s_nationkey") % 3).alias("cohort"))
    f = t.features().join(c, "patient_id").select("cohort", F.substring_index("feature", "_", 1).alias("root"), "patient_id", "feature", F.round("value", 6).alias("value"))
    pairs = spearman_pairs(f, ["cohort", "root"], 5).select("cohort", "root", "a", "b", F.round("rho", 9).alias("rho"))
    labels = f.select("root", "feature").distinct().select("root", "feature", F.explode(F.sequence(F.lit(2), F.lit(5))).alias("k")).withColumn("cluster", F.right("feature", F.lit(1)).cast("int") % F.col("k"))
    return cohort_reproducibility(pairs, labels, ["root"]).select("root", "k", *(F.round(x, 6).alias(x) for x in ("median_rho", "q25_rho", "share_positive", "share_modules_positive", "median_sd")))


@query("o187_matched_modules", "WITH RECURSIVE i AS (SELECT p_size % 2 AS half, (p_size * 7 + length(p_type)) % 4 AS ca, (p_size + p_partkey % 5) % 6 AS cb FROM part), n AS (SELECT half, ca, cb, count(*) AS n FROM i GROUP BY ALL), j AS (SELECT half, ca, cb, n / (sum(n) OVER (PARTITION BY half, ca) + sum(n) OVER (PARTITION BY half, cb) - n)::DOUBLE AS jac FROM n), rws AS (SELECT half, ca, row_number() OVER (PARTITION BY half ORDER BY ca) AS r FROM (SELECT DISTINCT half, ca FROM n)), cls AS (SELECT DISTINCT half, cb FROM n), way AS (SELECT half, 0::BIGINT AS r, []::BIGINT[] AS used, []::DOUBLE[] AS js FROM (SELECT DISTINCT half FROM n) UNION ALL SELECT w.half, x.r, list_append(used, c.cb::BIGINT), list_append(js, coalesce(jac, 0)) FROM way w JOIN rws x ON x.half = w.half AND x.r = w.r + 1 JOIN cls c ON c.half = w.half AND NOT list_contains(used, c.cb::BIGINT) LEFT JOIN j ON j.half = w.half AND j.ca = x.ca AND j.cb = c.cb), best AS (SELECT half, arg_max(js, list_sum(js)) AS js FROM way WHERE r = (SELECT max(r) FROM rws) GROUP BY half), k AS (SELECT half, sum(n) AS t, sum(n * (n - 1) / 2) AS bo FROM n GROUP BY half), l AS (SELECT half, sum(s * (s - 1) / 2) AS l FROM (SELECT half, ca, sum(n) AS s FROM n GROUP BY ALL) GROUP BY half), m AS (SELECT half, sum(s * (s - 1) / 2) AS m FROM (SELECT half, cb, sum(n) AS s FROM n GROUP BY ALL) GROUP BY half) SELECT half, t::BIGINT AS n_shared, round((bo - l * m / (t * (t - 1) / 2)) / ((l + m) / 2 - l * m / (t * (t - 1) / 2)), 9) AS ari, round(list_avg(js), 9) AS mean_jaccard, round(list_median(js), 9) AS median_jaccard, round(list_min(js), 9) AS min_jaccard, len(js)::INT AS n_matched FROM best JOIN k USING (half) JOIN l USING (half) JOIN m USING (half)")
def _o187_matched(t):
    p = t("part").withColumn("half", F.col("p_size") % 2).withColumnRenamed("p_partkey", "item")
    a = p.select("half", "item", ((F.col("p_size") * 7 + F.length("p_type")) % 4).alias("cluster"))
    b = p.select("half", "item", ((F.col("p_size") + F.col("item") % 5) % 6).alias("cluster"))
    return matched_modules(a, b, ["half"]).select("half", "n_shared", *(F.round(c, 9).alias(c) for c in ("ari", "mean_jaccard", "median_jaccard", "min_jaccard")), "n_matched")
