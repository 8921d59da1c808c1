"""The library's queries against their SQL on the smallest tables, and its numpy kernels against plain ones."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import TABLES, rows
from cytoloom.functions import scalars
from cytoloom.operators import aggregates, cohorts, compression, joins, models, neighbours, programs, shaping, spatial
from cytoloom.plans import registry
from cytoloom.sources import tables

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_logit_gradient_is_zero():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 2)), (rng.random(80) < 0.4).astype(float)
    b, _, _ = models.logit(x, y)
    d = np.column_stack([np.ones(80), x])
    assert np.abs(d.T @ (y - 1 / (1 + np.exp(-d @ b)))).max() < 1e-5


def test_cox_maximises_the_partial_likelihood():
    rng = np.random.default_rng(2)
    x, t, e = rng.normal(size=(50, 1)), rng.permutation(50) + 1.0, rng.random(50) < 0.7
    b, _, ll = models.cox(x, t, e)

    def plain(c):
        return sum(x[i, 0] * c - math.log(sum(math.exp(x[j, 0] * c) for j in range(50) if t[j] >= t[i])) for i in range(50) if e[i])

    assert ll == pytest.approx(plain(b[0]), abs=1e-6) and all(plain(b[0]) >= plain(b[0] + s) for s in (-0.01, 0.01))


def test_linkage_and_cut():
    d = np.abs(np.subtract.outer([0, 1, 10, 11, 30], [0, 1, 10, 11, 30])).astype(float)
    m = compression.linkage(d)
    assert compression.cut_tree(m, 5, k=3) == [0, 0, 1, 1, 2] and compression.cut_tree(m, 5, height=1.5) == [0, 0, 1, 1, 2]
    assert compression.silhouette(d, [0, 0, 1, 1, 2]) > 0.6


def test_greedy_passes():
    rho = {("a", "b"): 0.9, ("a", "c"): 0.1}
    assert compression.greedy_compression(["a", "b", "c"], {"a": 0.7, "b": 0.7, "c": 0.7}, rho, 0.8, 0.01) == {"a": "a", "b": "a", "c": "c"}
    assert compression.component_labels(list("abc"), [("a", "b")]) == {"a": "a", "b": "a", "c": "c"}


def test_radius_pairs_and_ripley(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"sample_id": 1, "cell_id": [str(i) for i in range(60)], "phenotype": "x", "x": rng.uniform(-5, 20, 60), "y": rng.uniform(0, 20, 60)})
    got = {(r.a, r.b) for r in spatial.radius_pairs(spark.createDataFrame(p), 3.0).collect()}
    assert got == {(a.cell_id, b.cell_id) for a, b in itertools.permutations(p.itertuples(), 2) if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 9}
    w, h = np.ptp(p["x"]), np.ptp(p["y"])

    def plain(r):
        return sum(1 / ((w - abs(a.x - b.x)) * (h - abs(a.y - b.y))) for a, b in itertools.permutations(p.itertuples(), 2) if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= r * r) * (w * h / 60) ** 2

    k = spatial.ripley(spark.createDataFrame(p), [3.0, 50.0]).collect()
    assert [(r.radius, r.n) for r in k] == [(3.0, 60)] and k[0].k == pytest.approx(plain(3.0)) and k[0].deviation == pytest.approx(plain(3.0) - 9 * math.pi)
    k = sorted(spatial.ripley(spark.createDataFrame(p), [40.0, 60.0]).collect(), key=lambda r: r.radius)
    assert [r.radius for r in k] == pytest.approx([min(w, h) * f for f in (0.025, 0.05, 0.1)]) and [r.k for r in k] == pytest.approx([plain(r.radius) for r in k])
    s = spatial.ripley_summary(spark.createDataFrame(k), 0.0).first()
    d = [r.deviation for r in k]
    assert s.at_radius == d[0] and abs(s.peak) == max(map(abs, d)) and s.area == pytest.approx(np.trapezoid(d, [r.radius for r in k]))


def test_nearest_by_rings():
    rng = np.random.default_rng(6)
    for p in (rng.uniform(0, 9, (300, 2)), rng.normal(0, 1, (50, 2)) ** 3, np.zeros((5, 2)), rng.uniform(0, 1, (1, 2)), np.column_stack([np.arange(40.0), np.zeros(40)])):
        q = np.concatenate([p[::2], rng.uniform(-5, 15, (30, 2))])
        own = np.concatenate([np.arange(len(p))[::2], np.full(30, -1)])
        d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
        d[own[:, None] == np.arange(len(p))[None]] = np.inf
        assert np.sqrt(neighbours.nearest(q, p, own)) == pytest.approx(d.min(axis=1))


def test_diversity_of_three_orders(spark):
    c = spark.createDataFrame([(1, "x", "T", "T", 3), (1, "x", "T", "S", 1), (1, "y", "S", "T", 2)], "sample_id long, a string, pa string, pb string, n long")
    renyi = lambda p, q: math.log(sum(x**q for x in p)) / (1 - q)
    for own, p in ((False, [0.75, 0.25]), (True, [0.8, 0.2])):
        r = {x.a: x for x in spatial.diversity(c, with_self=own).collect()}["x"]
        assert (r.renyi05, r.renyi2, r.renyi3) == pytest.approx(tuple(renyi(p, q) for q in (0.5, 2, 3))) and r.shannon == pytest.approx(-sum(x * math.log(x) for x in p))


def test_tails():
    """Values from printed tables."""
    assert models.p_of_t(2.776445, 4) == pytest.approx(0.05, abs=1e-6) and models.p_of_t(1.0, 1) == pytest.approx(0.5) and models.p_of_t(0, 7) == pytest.approx(1)
    assert models.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and models.chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-6) and models.chi2_tail(2, 2) == pytest.approx(math.exp(-1))
    assert models.chi2_tail(4.0, 1) == pytest.approx(models.p_of_z(2.0))


def test_signed_ranks_against_all_signs():
    rng = np.random.default_rng(8)
    for d in (np.array([0.2, 0.5, 0.9, 1.4, -0.1]), np.array([1.0, -1, 2, 2, 3, 0]), rng.normal(0.4, 1, 9)):
        x = d[d != 0]
        r = models.ranks(np.abs(x))
        w = r[x > 0].sum()
        every = np.array([sum(a for a, s in zip(r, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=len(x))])
        assert models.signed_rank_p(d) == pytest.approx(min(1, 2 * min((every <= w).mean(), (every >= w).mean())))
    assert models.signed_rank_p(np.array([0.2, 0.5, 0.9, 1.4, -0.1])) == 0.125


def test_paired_shift(spark):
    d = [0.2, 0.5, 0.9, 1.4, -0.1]
    r = models.paired_shift(spark.createDataFrame([("g", x) for x in d] + [("h", 1.0)], "g string, d double"), ["g"], "d").where("g = 'g'").first()
    t = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(5))
    assert r.t_p == pytest.approx(models.p_of_t(t, 4)) and 0.08 < r.t_p < 0.1 and r.wilcoxon_p == 0.125
    assert (r.n, r.fraction_up, r.fraction_down) == (5, 0.8, 0.2) and r.median_low <= r.median <= r.median_high and r.median == 0.5


def test_scores_against_pairs():
    rng = np.random.default_rng(9)
    y, s = (rng.random(70) < 0.4).astype(float), np.round(rng.normal(size=70), 1)
    pairs = [(a, b) for a in s[y == 1] for b in s[y == 0]]
    assert models.roc_auc(s, y) == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs]))
    steps, before = 0.0, 0.0
    for c in sorted(set(s), reverse=True):
        hit = s >= c
        recall = y[hit].sum() / y.sum()
        steps, before = steps + (recall - before) * y[hit].mean(), recall
    assert models.average_precision(s, y) == pytest.approx(steps)
    c = models.balanced_threshold(s, y)
    accuracy = lambda x: ((s >= x)[y == 1].mean() + (s < x)[y == 0].mean()) / 2
    assert accuracy(c) == pytest.approx(max(map(accuracy, s)))
    t, e = np.round(rng.exponential(5, 70)), rng.random(70) < 0.6
    want = [(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in range(70) for j in range(70) if e[i] and t[i] < t[j]]
    for block in (1, 7, 1024):
        won, n = models.concordant(t, e, s, block)
        assert n == len(want) and won == pytest.approx(sum(want))


def test_model_variants(spark):
    rng = np.random.default_rng(10)
    x, c = rng.normal(size=200), rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(1.5 * x + 0.5 * c)))).astype(int)
    d = pd.DataFrame({"patient_id": range(200), "g": 1, "value": x, "c": c, "y": y, "time": rng.exponential(size=200) * np.exp(-x) + 0.01, "event": rng.random(200) < 0.8})
    r = {q.variant: q for q in models.fit_models(spark.createDataFrame(d), ["g"], "logistic", ["c"]).collect()}
    f, both = r["feature"], r["combined"]
    assert f.effect == pytest.approx(math.exp(f.coef)) and f.effect_low < f.effect < f.effect_high and f.aic == pytest.approx(4 - 2 * f.log_likelihood) and f.auc > 0.75
    assert both.lrt_p == pytest.approx(models.chi2_tail(2 * (both.log_likelihood - r["clinical"].log_likelihood), 1)) and both.lrt_p < 1e-6 and r["clinical"].coef is None
    h = {q.variant: q for q in models.fit_models(spark.createDataFrame(d), ["g"], "cox", ["c"]).collect()}
    assert h["feature"].c_index > 0.65 and h["feature"].effect > 1.5 and h["clinical"].lrt_df == 1 and h["combined"].log_likelihood >= h["feature"].log_likelihood
    v = {q.variant: q for q in models.cv_auc(spark.createDataFrame(d), ["g"], ["c"]).collect()}
    assert v["feature"].oof_auc > 0.75 and v["combined"].oof_auc > v["clinical"].oof_auc and v["combined"].delta_auc == pytest.approx(v["combined"].oof_auc - v["clinical"].oof_auc) and v["feature"].oof_balanced_accuracy > 0.65 and v["feature"].n_repeats == 5


def test_cox_with_ties_against_plain_efron():
    rng = np.random.default_rng(11)
    x, t, e = rng.normal(size=(40, 2)), rng.integers(1, 8, 40).astype(float), rng.random(40) < 0.7
    b, _, ll = models.cox(x, t, e)

    def plain(c):
        out, r = 0.0, np.exp(x @ c)
        for u in np.unique(t[e]):
            d, risk = (t == u) & e, t >= u
            out += (x[d] @ c).sum() - sum(math.log(r[risk].sum() - k / d.sum() * r[d].sum()) for k in range(d.sum()))
        return out

    assert ll == pytest.approx(plain(b)) and all(plain(b) >= plain(b + s) for s in np.array([[0.01, 0], [-0.01, 0], [0, 0.01], [0, -0.01]]))


def test_spearman_in_blocks(spark):
    rng = np.random.default_rng(12)
    rows = [(p, f"f{f}", float(np.round(rng.normal(), 1))) for p in range(30) for f in range(7) if rng.random() < 0.8] + [(p, "flat", 1.0) for p in range(30)]
    d = spark.createDataFrame(rows, "patient_id long, feature string, value double")
    by = {f: {p: v for p, g, v in rows if g == f} for f in sorted({r[1] for r in rows})}
    want = {}
    for a, b in itertools.combinations(sorted(by), 2):
        both = sorted(set(by[a]) & set(by[b]))
        x, y = (models.ranks(np.array([by[f][p] for p in both])) for f in (a, b))
        want[a, b] = (len(both), None if "flat" in (a, b) else np.corrcoef(x, y)[0, 1])
    for block in (2, 256):
        got = {(r.a, r.b): (r.n, r.rho) for r in aggregates.spearman_pairs(d, [], 5, block).collect()}
        assert set(got) == set(want) and all(got[k][0] == want[k][0] and (got[k][1] is None) == (want[k][1] is None) and (got[k][1] is None or got[k][1] == pytest.approx(want[k][1])) for k in want)


def test_validated_join_raises(spark):
    d = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(ValueError):
        joins.join_validated(d, d, ["k"])


def test_simplify_follows_chains():
    rho = {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "c"): 0.1}
    got = programs.simplify(list("abc"), dict.fromkeys("abc", 0.5), rho, [(dict.fromkeys("abc", 1), {"a": 3, "b": 2, "c": 1})], 0.8, 0.01)
    assert got == {"a": "c", "b": "c", "c": "c"}
    lossy = programs.simplify(list("ab"), {"a": 0.9, "b": 0.5}, {("a", "b"): 0.9}, [(dict.fromkeys("ab", 1), {"a": 2, "b": 1})], 0.8, 0.01)
    assert lossy == {"a": "a", "b": "a"}  # the simpler one loses too much; the greedy pass keeps the better one


def test_cap_recommendation(spark):
    novel = [True] * 4 + [False] * 12
    rows = [("r", i + 1, min(i + 1, 4), min(i + 1, 4) / (i + 1), x) for i, x in enumerate(novel)]
    r = programs.recommended_caps(spark.createDataFrame(rows, "root string, depth int, n_novel int, novelty_yield double, is_novel boolean"), "root").first()
    assert (r.strict, r.balanced, r.permissive, r.elbow, r.recommended, r.at_boundary) == (4, 4, 4, 3, 3, False)


def test_k_evaluation_finds_the_planted_modules():
    names, rho = list("abcdef"), {}
    for x, y in itertools.combinations(names, 2):
        rho[x, y] = 0.9 if (x < "d") == (y < "d") else 0.0
    k2 = programs.evaluate_k(names, rho, {x: x < "d" for x in names}, [2, 3])[0]
    assert k2[0] == 2 and k2[1] > 0.8 and k2[2] == 0.5 and k2[3] == 0 and k2[4] == pytest.approx(1) and k2[5] == pytest.approx(0.6)


def test_meta_modules_join_agreeing_roots(spark):
    rng, rows = np.random.default_rng(4), []
    for cohort in ("x", "y"):
        for p in range(30):
            v, w = rng.normal(size=2)
            rows += [(cohort, "P", f"{cohort}{p}", "r1", "m1", float(v)), (cohort, "P", f"{cohort}{p}", "r2", "m1", float(v + 0.01 * w)), (cohort, "P", f"{cohort}{p}", "r1", "m2", float(w))]
    s = spark.createDataFrame(rows, "cohort string, panel string, patient_id string, root string, module string, score double")
    got = {(r.root, r.module): r.accepted for r in programs.meta_modules(s, 5, [0.5]).collect()}
    assert got == {("r1", "m1"): True, ("r2", "m1"): True, ("r1", "m2"): False}


def test_frozen_definitions():
    with pytest.raises(ValueError):
        programs.check_frozen({"k": 3}, {"k": 2})


def test_sections_by_batch_name(spark, tmp_path):
    for i, b in enumerate(("Batch1", "Batch 1", "Batch_1", "Batch10")):
        spark.range(i, i + 1).write.parquet(f"{tmp_path}/P1/{b}")
    assert sorted(r.id for r in cohorts.section_rows(spark, str(tmp_path), "P1", 1).collect()) == [0, 1, 2]


def test_tolerant_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,café\n".encode("windows-1252"))
    assert tables.read_tolerant(spark, f"{tmp_path}/a.csv").first().v == "café"


def test_support_filter_drops_unsupported_features(spark):
    p = spark.createDataFrame([("a", "b", 0.9, 2), ("a", "c", 0.8, 1), ("b", "c", 0.7, 1), ("a", "d", 0.6, 2)], "a string, b string, consensus_rho double, support int")
    got = {(r.a, r.b): r.rho for r in shaping.support_filter(p, 2, 0.5).collect()}
    assert got == {("a", "b"): 0.9, ("a", "d"): 0.6}


def test_survival_cv_ranks_a_planted_risk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=80)
    d = pd.DataFrame({"patient_id": range(80), "g": 1, "value": x, "time": rng.exponential(size=80) * np.exp(-2 * x), "event": True})
    r = {q.variant: q for q in shaping.survival_cv(spark.createDataFrame(d.assign(c=rng.normal(size=80))), ["g"], ["c"]).collect()}
    assert r["feature"].oof_c_index > 0.75 and r["feature"].n_repeats == 5 and r["combined"].delta_c_index > 0.1 and r["clinical"].delta_c_index == 0


def test_chunk_scan_prunes_folders(spark, tmp_path):
    spark.createDataFrame([("x", 1.0, "c0", "P", 1), ("y", 2.0, "c1", "Q", 2)], "cell_id string, x double, cohort string, panel string, chunk int").write.partitionBy("cohort", "panel", "chunk").option("sep", "\t").option("header", True).csv(f"{tmp_path}/c")
    d = shaping.chunk_scan(spark, f"{tmp_path}/c", "cell_id string, x double, cohort string, panel string, chunk int", ["Q"])
    assert [r.cell_id for r in d.collect()] == ["y"] and "PartitionFilters: [isnotnull(panel" in d._jdf.queryExecution().toString()


def test_dendrogram_order_and_names():
    d = np.abs(np.subtract.outer([0, 10, 1, 11, 30], [0, 10, 1, 11, 30])).astype(float)
    m = compression.linkage(d)
    order = compression.leaf_order(m, 5)
    assert sorted(order) == [0, 1, 2, 3, 4] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    names = compression.module_names(m, 5, compression.cut_tree(m, 5, k=3))
    assert names[0] == names[2] and names[1] == names[3] and names[order[0]] == "M01" and set(names) == {"M01", "M02", "M03"}


def test_microfamilies_keep_the_best_member():
    family = {"a1": "a", "a2": "a", "a3": "a", "b1": "b"}
    rho = {("a1", "a2"): 0.9, ("a2", "b1"): 0.9, ("a1", "a3"): 0.1}
    got = compression.microfamilies(list(family), family, rho, {"a1": 1, "a2": 3, "a3": 2, "b1": 9}, 0.5)
    assert got == {"a1": ("a", "a2"), "a2": ("a", "a2"), "a3": ("a", "a3"), "b1": ("b", "b1")}


def test_one_hot_takes_the_levels_of_training_rows(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "new"), (5, None)], "k long, v string")
    got = sorted(tuple(r) for r in scalars.one_hot(d, d.where("k < 4"), ["v"]).collect())
    assert got == [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 0, 0), (5, 0, 0)]
    with pytest.raises(ValueError):
        scalars.one_hot(d, d, ["v"], most=2)


def test_log1p_of_a_negative_value_is_an_error(spark):
    from pyspark.sql import Window

    d = spark.createDataFrame([(1, 2.0), (2, -1.0)], "k long, v double")
    with pytest.raises(Exception, match="negative"):
        d.select(scalars.zscore("v", Window.partitionBy(), log1p=True)).collect()


def test_files_are_listed_without_being_read(spark, tmp_path):
    for n in ("A (2)_Core[1,2]_x.txt", "sub/B_Core[3,4]_x.txt", "sub/C.log"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text("abc")
    f = tables.files_of(spark, str(tmp_path), "*.txt")
    got = sorted(tuple(r) for r in f.select(tables.cohort_prefix(F.col("file"), ["A", "B"]), tables.core_key(F.col("file"), "_x.txt"), "bytes").collect())
    assert len(got) == 2 and {r[0] for r in got} == {"A", "B"} and all(r[2] == 3 for r in got)


def test_unfinished_parts_are_an_error(spark, tmp_path):
    (tmp_path / "p").mkdir()
    with pytest.raises(Exception, match="already exists"):
        tables.write_parts(spark.range(3), str(tmp_path / "p"))
    assert tables.write_parts(spark.range(30), str(tmp_path / "q"), merge=True) and len(list((tmp_path / "q").glob("*.parquet"))) == 1
