"""Feature compression, clustering, module scores: O163 to O187."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.registry import EVIDENCE, FEATURES, query
from .aggregates import spearman_pairs


def component_labels(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """O164, O173: the least member of each node's component."""
    parent = {n: n for n in nodes}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def greedy_compression(order: list[str], oof: dict[str, float], rho: dict[tuple[str, str], float], least: float, loss: float) -> dict[str, str]:
    """O167, O168: each feature's representative: the first kept one with rho of at least `least` and no more than `loss` behind it; an unknown rho never merges."""
    kept, rep = [], {}
    for u in order:
        rep[u] = next((v for v in kept if (r := rho.get((min(u, v), max(u, v)))) is not None and r >= least and oof[u] - oof[v] <= loss), u)
        if rep[u] == u:
            kept.append(u)
    return rep


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float]]:
    """O177: agglomerative merges (cluster, cluster, height) of a distance matrix, from the lowest up; in each the cluster of the least member comes first.

    Chains of nearest neighbours: from any cluster to its nearest one and on, until two are nearest to each other, which merge whatever else
    does. So each merge costs a few rows, O(n^2) in all. Of equally near clusters the one before in the chain is taken, then the first; equal
    heights keep the order in which their merges were found.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, there, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(there)))
        while True:
            row = d[chain[-1]]
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                break
            chain.append(j)
        i, j = sorted((chain.pop(), chain.pop()))
        found.append((i, j, float(d[i, j])))
        row = np.maximum(d[i], d[j]) if method == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        there[j] = False
    parent, name, out = list(range(n)), list(range(n)), []
    for step, (i, j, h) in enumerate(sorted(found, key=lambda m: m[2])):
        while parent[i] != i:
            i = parent[i]
        while parent[j] != j:
            j = parent[j]
        i, j = min(i, j), max(i, j)
        out.append((name[i], name[j], h))
        parent[j], name[i] = i, n + step
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int | None = None, height: float | None = None) -> list[int]:
    """O177, O180: labels after the first n-k merges, or after those of at most a height; numbered by first member."""
    parent = list(range(2 * n))
    use = merges[: n - k] if k else [m for m in merges if m[2] <= height]
    at = {(a, b): n + i for i, (a, b, _) in enumerate(merges)}
    for a, b, _ in use:
        parent[a] = parent[b] = at[a, b]
    roots = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    seen: dict[int, int] = {}
    return [seen.setdefault(r, len(seen)) for r in roots]


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """O180: leaves from left to right under the last merge, each merge's first cluster left."""
    stack, out = [n + len(merges) - 1] if merges else list(range(n)), []
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += [merges[x - n][1], merges[x - n][0]]
    return out


def module_names(merges: list[tuple[int, int, float]], n: int, labels: list[int]) -> list[str]:
    """O180: M01, M02 and so on, by the first leaf of each cluster in dendrogram order."""
    seen: dict[int, str] = {}
    for leaf in leaf_order(merges, n):
        seen.setdefault(labels[leaf], f"M{len(seen) + 1:02d}")
    return [seen[x] for x in labels]


def microfamilies(names: list[str], family: dict[str, str], rho: dict[tuple[str, str], float], score: dict[str, float], least: float) -> dict[str, tuple[str, str]]:
    """O173: of each feature its family and its representative: families by parsed key, components of pairs in one family with rho of at least `least`, and of each the member of the best score, the least name of equals."""
    edges = [(a, b) for (a, b), r in rho.items() if r >= least and family.get(a) == family.get(b) and a in family and b in family]
    label = component_labels(names, edges)
    best: dict[str, str] = {}
    for x in sorted(names, key=lambda x: (-score[x], x)):
        best.setdefault(label[x], x)
    return {x: (family[x], best[label[x]]) for x in names}


def silhouette(d: np.ndarray, labels: list[int]) -> float:
    """O178: mean silhouette from distances; a lone member scores 0."""
    lab, s = np.array(labels), []
    for i in range(len(lab)):
        own = (lab == lab[i]) & (np.arange(len(lab)) != i)
        if not own.any() or len(set(labels)) < 2:
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, lab == x].mean() for x in set(labels) if x != lab[i])
        s.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(s))


def cluster_features(pairs: DataFrame, ks: list[int], method: str = "average") -> DataFrame:
    """O176 to O180: per root, features clustered on 1 - rho for each K, with the silhouette. One root's features (some hundreds) meet in a task, as the linkage needs."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*p["a"], *p["b"]})
        at, d = {x: i for i, x in enumerate(names)}, np.ones((len(names), len(names)))
        for a, b, r in zip(p["a"], p["b"], p["rho"], strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = np.clip(1 - (0 if pd.isna(r) else r), 0, 2)
        np.fill_diagonal(d, 0)
        merges, rows = linkage(d, method), []
        for k in ks:
            if k <= len(names):
                lab = cut_tree(merges, len(names), k=k)
                s = silhouette(d, lab)
                rows += [(key[0], k, x, lab[i], s) for i, x in enumerate(names)]
        return pd.DataFrame(rows, columns=["root", "k", "feature", "module", "silhouette"])

    return pairs.groupBy("root").applyInPandas(run, "root string, k int, feature string, module int, silhouette double")


def module_scores(z: DataFrame, membership: DataFrame, least: float = 0.5) -> DataFrame:
    """O182, O184: mean of the members' z per patient and module; null under the coverage."""
    m = membership.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("module")))
    g = z.where("z IS NOT NULL").join(F.broadcast(m), "feature").groupBy("patient_id", "module").agg(F.avg("z").alias("m"), F.count("z").alias("n_present"), F.max("size").alias("size"))
    return g.select("patient_id", "module", "n_present", F.when(F.col("n_present") >= least * F.col("size"), F.col("m")).alias("score"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """O187: adjusted Rand index of two labelings, from their contingency counts."""
    c2 = lambda c: F.sum(c * (c - 1) / 2)
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    x = n.agg(c2(F.col("n")).alias("nij"), F.sum("n").alias("t"))
    y = n.groupBy(a).agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("ai"))
    z = n.groupBy(b).agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("bj"))
    e = F.col("ai") * F.col("bj") / (F.col("t") * (F.col("t") - 1) / 2)
    return x.join(F.broadcast(y), F.lit(True)).join(F.broadcast(z), F.lit(True)).select(((F.col("nij") - e) / ((F.col("ai") + F.col("bj")) / 2 - e)).alias("ari"))


def _pairs(t) -> DataFrame:
    f = t.features().select("patient_id", "feature", F.round("value", 6).alias("value"), F.substring_index("feature", "_", 1).alias("root"))
    return spearman_pairs(f, ["root"], 5).select("root", "a", "b", F.round("rho", 9).alias("rho"))


def _per_root(t, fn, schema: str, columns: list[str]) -> DataFrame:
    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*p["a"], *p["b"]})
        rho = {(a, b): r for a, b, r in zip(p["a"], p["b"], p["rho"], strict=True) if r is not None and not pd.isna(r)}
        return pd.DataFrame([(key[0], *r) for r in fn(names, rho)], columns=columns)

    return _pairs(t).groupBy("root").applyInPandas(run, schema)


_ROOTS = f"{FEATURES}, ff AS (SELECT patient_id, split_part(feature, '_', 1) AS root, feature, round(value, 6) AS value FROM features), j AS (SELECT a.root, a.feature AS a, b.feature AS b, a.value AS va, b.value AS vb FROM ff a JOIN ff b ON a.root = b.root AND a.patient_id = b.patient_id AND a.feature < b.feature), r AS (SELECT root, a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM j), rho AS (SELECT root, a, b, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 9) AS rho FROM r GROUP BY ALL HAVING count(*) >= 5)"


@query("o164_graph_components", f"WITH RECURSIVE {_ROOTS}, n AS (SELECT root, a AS x FROM rho UNION SELECT root, b FROM rho), e AS (SELECT root, a AS x, b AS y FROM rho WHERE abs(rho) >= 0.2 UNION SELECT root, b, a FROM rho WHERE abs(rho) >= 0.2), c AS (SELECT root, x, x AS m FROM n UNION SELECT e.root, e.y, c.m FROM c JOIN e ON e.root = c.root AND e.x = c.x WHERE c.m < e.y) SELECT root, x AS feature, min(m) AS component FROM c GROUP BY ALL")
def _o164(t):
    return _per_root(t, lambda names, rho: component_labels(names, [k for k, r in rho.items() if abs(r) >= 0.2]).items(), "root string, feature string, component string", ["root", "feature", "component"])


@query("o169_cap_grid", f"WITH {EVIDENCE}, r AS (SELECT context, oof, row_number() OVER (PARTITION BY context ORDER BY oof DESC, feature) AS k FROM evidence) SELECT context, cap::INT AS cap, thr::DOUBLE AS thr, count(*) AS n, count(*) BETWEEN 5 AND 30 AS passes FROM r JOIN (SELECT unnest([10, 20, 40]) AS cap) ON k <= cap JOIN (SELECT unnest([0.2, 0.5, 0.8]) AS thr) ON oof >= thr GROUP BY ALL")
def _o169(t):
    r = t.evidence().withColumn("k", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("oof"), "feature")))
    g = r.withColumn("cap", F.explode(F.array(*map(F.lit, (10, 20, 40))))).withColumn("thr", F.explode(F.array(*map(F.lit, (0.2, 0.5, 0.8))))).where("k <= cap AND oof >= thr")
    return g.groupBy("context", "cap", "thr").agg(F.count(F.lit(1)).alias("n")).withColumn("passes", F.col("n").between(5, 30))


@query("o174_root_universe", f"WITH {EVIDENCE}, u AS (SELECT source, feature % 200 AS f, count(DISTINCT context) AS contexts, max(oof) AS best, round(median(oof), 6) AS med FROM evidence GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source ORDER BY contexts DESC, best DESC, f)::INT AS universe_rank FROM u")
def _o174(t):
    u = t.evidence().groupBy("source", (F.col("feature") % 200).alias("f")).agg(F.count_distinct("context").alias("contexts"), F.max("oof").alias("best"), F.round(F.median("oof"), 6).alias("med"))
    return u.withColumn("universe_rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("contexts"), F.desc("best"), "f")))


@query("o177_feature_modules")
def _o177(t):
    return cluster_features(_pairs(t), [2, 4, 8])


@query("o182_module_scores", f"WITH {FEATURES}, z AS (SELECT patient_id, feature, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM features WINDOW w AS (PARTITION BY feature)), m AS (SELECT feature, substr(feature, length(feature), 1) AS module FROM (SELECT DISTINCT feature FROM features)), s AS (SELECT module, count(*) AS size FROM m GROUP BY 1) SELECT patient_id, module, count(z) AS n_present, round(CASE WHEN count(z) >= 0.5 * any_value(size) THEN avg(z) END, 5) AS score FROM z JOIN m USING (feature) JOIN s USING (module) GROUP BY ALL HAVING count(z) > 0")
def _o182(t):
    from ..functions.scalars import zscore

    f = t.features()
    z = f.select("patient_id", "feature", zscore("value", Window.partitionBy("feature"), sample_sd=False).alias("z"))
    m = f.select("feature").distinct().withColumn("module", F.substring("feature", -1, 1))
    return module_scores(z, m).withColumn("score", F.round("score", 5))


@query("o187_adjusted_rand", "WITH n AS (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS nij, sum(n) AS t FROM n), y AS (SELECT sum(n * (n - 1) / 2) AS ai FROM (SELECT sum(n) AS n FROM n GROUP BY a)), z AS (SELECT sum(n * (n - 1) / 2) AS bj FROM (SELECT sum(n) AS n FROM n GROUP BY b)) SELECT round((nij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 9) AS ari FROM x, y, z")
def _o187(t):
    return adjusted_rand(t("part"), "p_type", "p_brand").select(F.round("ari", 9).alias("ari"))


@query("o180_module_names")
def _o180(t):
    def fn(names, rho):
        d = np.array([[0.0 if x == y else 1 - rho.get((min(x, y), max(x, y)), 0.0) for y in names] for x in names])
        merges = linkage(d)
        labels = cut_tree(merges, len(names), k=min(4, len(names)))
        return zip(names, module_names(merges, len(names), labels), [leaf_order(merges, len(names)).index(i) for i in range(len(names))], strict=True)

    return _per_root(t, fn, "root string, feature string, module string, place int", ["root", "feature", "module", "place"])
