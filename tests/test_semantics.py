"""Similarity of names, cohesion of modules and matched modules against plain loops."""

import itertools
import statistics

import numpy as np
import pytest

from cytoloom.functions import feature_grammar as G
from cytoloom.operators import semantics as S


def test_assignment_against_all_permutations():
    r = np.random.default_rng(1)
    for _ in range(300):
        m, n = r.integers(1, 6, 2)
        gain = np.round(r.random((m, n)), int(r.integers(0, 4)))
        got = S.assign(gain)
        assert sum(c >= 0 for c in got) == min(m, n) and len({c for c in got if c >= 0}) == min(m, n)
        wide = gain if m <= n else gain.T
        best = max(sum(wide[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert sum(gain[i, c] for i, c in enumerate(got) if c >= 0) == pytest.approx(best)


def test_matched_modules(spark):
    r = np.random.default_rng(2)
    a = [("x", int(i), int(r.integers(3))) for i in range(40)] + [("y", 1, 0), ("y", 2, 1), ("x", 3, 9), ("x", None, 1)]
    b = [("x", int(i), f"m{int(r.integers(4))}") for i in range(5, 50)] + [("y", 1, "m0"), ("z", 1, "m0")]
    got = {x.key: x for x in S.matched_modules(spark.createDataFrame(a, "key string, item int, cluster int"), spark.createDataFrame(b, "key string, item int, cluster string"), ["key"]).collect()}
    assert set(got) == {"x", "y"} and got["y"].n_shared == 1 and got["y"].ari is None and got["y"].n_matched == 0
    da, db = {i: c for k, i, c in reversed(a) if k == "x" and i is not None and c != 9}, {i: c for k, i, c in b if k == "x"}
    items = sorted(set(da) & set(db))
    sets = [[{i for i in items if d[i] == c} for c in sorted({d[i] for i in items})] for d in (da, db)]
    jac = np.array([[len(p & q) / len(p | q) for q in sets[1]] for p in sets[0]])
    best = max(itertools.permutations(range(jac.shape[1]), jac.shape[0]), key=lambda p: sum(jac[i, c] for i, c in enumerate(p)))
    m = [jac[i, c] for i, c in enumerate(best)]
    x = got["x"]
    assert (x.n_shared, x.n_matched) == (len(items), 3)
    assert (x.mean_jaccard, x.median_jaccard, x.min_jaccard) == pytest.approx((statistics.mean(m), statistics.median(m), min(m)))
    pairs = list(itertools.combinations(items, 2))
    agree = sum((da[p] == da[q]) and (db[p] == db[q]) for p, q in pairs)
    na, nb = sum(da[p] == da[q] for p, q in pairs), sum(db[p] == db[q] for p, q in pairs)
    assert x.ari == pytest.approx((agree - na * nb / len(pairs)) / ((na + nb) / 2 - na * nb / len(pairs)))


NAMES = [("phenotype_only", "NN", "cd8_to_tumor_Mean"), ("phenotype_only", "NN", "cd8_to_nk_Mean"), ("phenotype_only", "NN", "nk_to_cd8_SD"), ("phenotype_only", "cell_features", "Epi__prop__cd8"), ("phenotype_only", "cell_features", "All__count__cd8"), ("phenotype_only", "athena", "hill_x_q2__All__max"), ("AR_checkpoint_state", "cell_features", "All__count__PD1"), ("compartment_state", "cell_features", "All__prop__tumor_PD1"), ("compartment_state", "cell_features", "All__prop__immune_PD1")]


def similar(spark):
    d = spark.createDataFrame([(s, f"{i}", s, g, n) for i, (s, g, n) in enumerate(NAMES)], "root string, feature string, src string, grp string, name string")
    return S.ontology_similarity(G.parse_features(d, "name", "src", "grp"), ["root"])


def test_similarity_by_hand(spark):
    got = {(r.a, r.b): r for r in similar(spark).collect()}
    r = got["0", "1"]  # one of three roles shared, the same measure and summary
    assert (r.primitive, r.tissue, r.family, r.summary, r.params) == (pytest.approx(1 / 3), None, 1, 1, None)
    assert (r.metric, r.tissue_aware, r.metric_aware) == pytest.approx((1, 1 / 3, (0.55 / 3 + 0.25) / 0.8))
    r = got["1", "2"]  # the same cells in other roles
    assert (r.primitive, r.metric) == (0, pytest.approx(0.6 / 0.8))
    r = got["3", "4"]  # the same cell in another place and measure: two of four words of the family shared
    assert (r.primitive, r.tissue, r.family, r.summary) == (1, 0, 0.5, None) and r.tissue_aware == 0.75 and r.metric_aware == pytest.approx(0.55 + 0.25 * 0.5)
    assert got["4", "5"].tissue == 1 and got["4", "5"].params == 0 and got["4", "5"].primitive == 0
    assert got["7", "8"].primitive == pytest.approx(1 / 3)  # the state, not the cell
    assert ("0", "4") not in got and ("4", "6") not in got  # nothing shared; another root


def test_coherence_against_all_pairs(spark):
    s = similar(spark).where("root = 'phenotype_only'").cache()
    sim = {(r.a, r.b): r.metric_aware for r in s.collect()}
    names = [str(i) for i in range(6)]
    clusters = {2: dict(zip(names, [0, 0, 0, 1, 1, 1], strict=True)), 6: {n: int(n) for n in names}}
    lab = spark.createDataFrame([("phenotype_only", k, n, c) for k, m in clusters.items() for n, c in m.items()], "root string, k int, feature string, cluster int")
    got = {r.k: r for r in S.semantic_coherence(s, lab, ["root"], "metric_aware").collect()}
    pairs = list(itertools.combinations(names, 2))
    inside = [sim.get(p, 0) for p in pairs if clusters[2][p[0]] == clusters[2][p[1]]]
    assert got[2].raw == pytest.approx(statistics.mean(inside)) and got[2].null_mean == pytest.approx(statistics.mean(sim.get(p, 0) for p in pairs))
    assert got[6].raw is None and got[6].pairs_within == 0
    one, two = (S.coherence_null(s, lab, ["root"], "metric_aware", n_perm=200, blocks=b).collect() for b in (1, 7))
    assert len(one) == len(two) == 1 and tuple(one[0])[2:] == pytest.approx(tuple(two[0])[2:])
    assert one[0].null_average == pytest.approx(got[2].null_mean, abs=0.05) and one[0].p <= 0.2 and one[0].z == pytest.approx((got[2].raw - one[0].null_average) / one[0].null_sd)


def test_cohorts(spark):
    rho = [("r", "A", "a", "b", 0.5), ("r", "B", "a", "b", -0.1), ("r", "A", "a", "c", 0.9), ("r", "A", "d", "e", 0.2), ("r", "A", "b", "c", None), ("r", "C", "b", "c", 0.3)]
    lab = [("r", 2, x, int(x in "de")) for x in "abcde"]
    (g,) = S.cohort_reproducibility(spark.createDataFrame(rho, "root string, cohort string, a string, b string, rho double"), spark.createDataFrame(lab, "root string, k int, feature string, cluster int"), ["root"]).collect()
    means = [0.7, -0.1, 0.3, 0.2]
    assert g.median_rho == pytest.approx(0.25) and g.q25_rho == pytest.approx(np.quantile(means, 0.25)) and g.share_positive == 0.75
    assert g.share_modules_positive == 0.5 and g.median_sd == pytest.approx(statistics.stdev([0.7, -0.1, 0.3]) / 2)
