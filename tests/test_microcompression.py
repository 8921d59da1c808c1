"""Compression on vectors against plain loops over all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import microcompression as M

REG = "root string, feature string, oof double, exact_key string, summary_key string, summary string, other int"
VAL = "root string, feature string, patient_id int, value double"


def table(spark, vectors, keys):
    """vectors: name -> list of values (None: missing); keys: name -> (oof, exact key, summary key, summary)."""
    reg = spark.createDataFrame([("r", f, *k, 1) for f, k in keys.items()], REG)
    val = spark.createDataFrame([("r", f, i, x) for f, v in vectors.items() for i, x in enumerate(v)], VAL)
    return M.evidence_order(reg, ["root"], [F.desc_nulls_last("oof")]), val


def test_tolerance_on_both_sides(spark):
    base = [0.1, -2.5, None, 1e3, 0.0]
    shift = lambda d, at=range(5): [None if x is None else x + (d if i in at else 0) for i, x in enumerate(base)]
    vectors = {"a": base, "in": shift(0.9e-6), "in2": shift(-0.9e-6), "out": shift(1.2e-6, [3]), "gap": [0.1, -2.5, 0.0, 1e3, 0.0], "less": base[:4], "other": base, "loose": base, "loose2": base, "none": [None] * 5, "none2": [None] * 5}
    keys = {f: (1.0, {"other": "y", "loose": None, "loose2": None}.get(f, "x"), None, None) for f in vectors}
    r, v = table(spark, vectors, keys)
    got = {frozenset(p) for p in M.near_equal_vectors(r, v, ["root"], atol=1e-6).select("a", "b").collect()}
    assert got == {frozenset(p) for p in [("a", "in"), ("a", "in2"), ("in", "out")]}
    assert {frozenset(p) for p in M.near_equal_vectors(r, v, ["root"], atol=2e-6).select("a", "b").collect()} == {frozenset(p) for p in itertools.combinations(["a", "in", "in2"], 2)} | {frozenset(p) for p in (("a", "out"), ("in", "out"))}


def test_near_vectors_against_all_pairs(spark):
    """Sums near the edges of buckets and steps of all sizes."""
    r = np.random.default_rng(3)
    vectors, keys = {}, {}
    for g in range(40):
        x = r.normal(size=6) * 10.0 ** r.integers(-8, 9)
        for c in range(4):
            name = f"{g}-{c}"
            vectors[name], keys[name] = (x + r.uniform(-1, 1, 6) * 10.0 ** r.integers(-8, -4)).tolist(), (float(r.random()), f"k{g % 5}", None, None)
    reg, v = table(spark, vectors, keys)
    got = {frozenset(p) for p in M.near_equal_vectors(reg, v, ["root"], atol=1e-6).select("a", "b").collect()}
    want = {frozenset((p, q)) for p, q in itertools.combinations(vectors, 2) if keys[p][1] == keys[q][1] and np.abs(np.subtract(vectors[p], vectors[q])).max() <= 1e-6}
    assert len(want) > 20 and got == want


def spearman(x, y):
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    return float(np.corrcoef(rank(np.array(x)), rank(np.array(y)))[0, 1])


def plain(vectors, keys, summary, residual):
    order = sorted(keys, key=lambda f: (-keys[f][0], f))
    active, to, rule_of = set(keys), {}, {}

    def run(rule, key, fits):
        for k in {keys[f][key] for f in active} - {None}:
            reps = []
            for f in [x for x in order if x in active and keys[x][key] == k]:
                rep = next((x for x in reps if fits(x, f)), None)
                if rep is None:
                    reps.append(f)
                else:
                    to[f], rule_of[f] = rep, rule
            active.difference_update(to)

    run("equal_vectors", 1, lambda a, b: np.abs(np.subtract(vectors[a], vectors[b])).max() <= 1e-12)
    loss = lambda a, b: keys[b][0] - keys[a][0]
    locations = {f for f in keys if (keys[f][3] or "").lower() in M.LOCATIONS}
    run("mean_and_median", 2, lambda a, b: {a, b} <= locations and keys[a][3] != keys[b][3] and spearman(vectors[a], vectors[b]) >= summary[0] and loss(a, b) <= summary[1])
    run("same_meaning", 1, lambda a, b: spearman(vectors[a], vectors[b]) >= residual[0] and loss(a, b) <= residual[1])

    def last(f):
        while f in to:
            f = to[f]
        return f

    return {f: (rule_of.get(f), to.get(f), last(f)) for f in keys}


@pytest.mark.parametrize("seed", [0, 1])
def test_three_passes_against_plain_loops(spark, seed):
    r = np.random.default_rng(seed)
    vectors, keys = {}, {}
    for m in range(6):
        base = r.normal(size=30)
        for s, stat in enumerate(["mean", "Median", "max"]):
            for c in range(4):
                name = f"{m}-{s}-{c}"
                copy = c == 3 and f"{m}-{s}-0" in vectors
                vectors[name] = (np.array(vectors[f"{m}-{s}-0"]) + 3e-13).tolist() if copy else (base + r.normal(size=30) * 0.3).tolist()
                keys[name] = (round(float(r.random()) * 0.1, 3), None if m == 5 and c == 1 else f"e{m}-{s}", None if m == 5 and c == 1 else f"s{m}", stat)
    reg, v = table(spark, vectors, keys)
    got = {x.feature: (x.rule, x.representative, x.final) for x in M.compress(reg, v, ["root"], summary=(0.85, 0.02), residual=(0.8, 0.01)).collect()}
    want = plain(vectors, keys, (0.85, 0.02), (0.8, 0.01))
    assert got == want and {x[0] for x in got.values()} == {None, "equal_vectors", "mean_and_median", "same_meaning"}
    assert any(x[1] is not None and x[1] != x[2] for x in got.values())
    assert M.compress(reg.limit(0), v.limit(0), ["root"]).count() == 0
