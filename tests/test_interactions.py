"""Shuffles as bijections and scores against plain counting."""

import numpy as np
import pytest

from cytoloom.operators import interactions as I

SCHEMA = "sample_id long, cell_id string, x double, y double, phenotype string"


@pytest.mark.parametrize("drawn", [0, 1 << 16])
def test_shuffles_are_bijections_and_spread(monkeypatch, drawn):
    monkeypatch.setattr(I, "DRAWN", drawn)
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        for key in (0, 1, 12345678901234567890):
            assert sorted(I.shuffled(np.arange(n), n, key).tolist()) == list(range(n))
    n, hits = (6, np.zeros((6, 6))) if drawn else (300, np.zeros((6, 6)))
    for key in range(6000 if drawn else 400):
        i = np.arange(n)
        np.add.at(hits, (i * 6 // n, I.shuffled(i, n, key << 32) * 6 // n), 1)
    assert abs(hits / hits.sum(axis=1, keepdims=True) - 1 / 6).max() < 0.025


def cells(seed=1):
    r = np.random.default_rng(seed)
    rows = [(g, f"c{i}", float(x), float(y), str(z)) for g in (1, 2) for i, (x, y, z) in enumerate(zip(r.uniform(0, 12, 150), r.uniform(0, 12, 150), r.choice(["Tumor", "nk", "t", "Other"], 150), strict=True))]
    rows += [(3, f"c{i}", i * 50.0, 0.0, "nk" if i % 2 else "t") for i in range(20)]  # no edges
    rows += [(4, f"c{i}", i * 0.5, 0.0, "nk" if i > 1 else "t") for i in range(20)]  # one label of enough cells
    return rows + [(1, "lost", None, 1.0, "nk"), (1, "bare", 1.0, 1.0, None)]


def plain(rows, g, r, n_perm, seed):
    import zlib

    own = sorted((x for x in rows if x[0] == g and x[2] is not None and x[4] is not None), key=lambda x: x[1])
    xy, lab = np.array([x[2:4] for x in own]), np.array([x[4] for x in own])
    names = sorted(set(lab))
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= r * r
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)

    def share(z):
        t = np.array([[np.sum((z[a] == p) & (z[b] == q)) for q in names] for p in names], float)
        return t / np.maximum(t.sum(1, keepdims=True), 1)

    laid = np.sort(lab)
    perm = np.stack([share(laid[I.shuffled(np.arange(len(lab)), len(lab), (seed << 48) ^ (i << 32) ^ zlib.crc32(str(g).encode()))]) for i in range(n_perm)])
    seen = share(lab)
    return {(p, q): (seen[i, j], seen[i, j] - perm[:, i, j].mean(), (seen[i, j] - perm[:, i, j].mean()) / perm[:, i, j].std(ddof=1)) for i, p in enumerate(names) for j, q in enumerate(names)}


@pytest.mark.parametrize("edges", [200_000, 37])
def test_scores_for_any_number_of_blocks(spark, monkeypatch, edges):
    monkeypatch.setattr(I, "EDGES", edges)
    rows = cells()
    got = {(r.sample_id, r.pa, r.pb): (r.observed, r.diff, r.z) for r in I.permutation_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), 1.5, 20, 3).collect()}
    want = {(g, p, q): v for g in (1, 2) for (p, q), v in plain(rows, g, 1.5, 20, 3).items() if "Other" not in (p, q)}
    assert set(got) ^ set(want) == set()
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_edges_are_counted_where_they_are_found(spark, monkeypatch):
    """60 cells in one spot have 1,770 edges: a line a label crosses the network, however many edges and samples are counted at once. Before, each edge was shuffled both ways."""
    rows = [(g, f"c{i}", 1.0, i / 1000, "nk" if i % 3 else "t") for g in (1, 2, 3) for i in range(60)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {(g, *k): v for g in (1, 2, 3) for k, v in plain(rows, g, 1.0, 5, 1).items()}
    for counts in (4_000_000, 1):
        monkeypatch.setattr(I, "COUNTS", counts)
        out = I.permutation_scores(d, 1.0, 5)
        got = {(r.sample_id, r.pa, r.pb): (r.observed, r.diff, r.z) for r in out.collect()}
        assert set(got) == set(want) and all(got[k][:2] == pytest.approx(want[k][:2]) for k in want)
        assert "CoGroup" not in out._jdf.queryExecution().executedPlan().toString()
    points = d.selectExpr("sample_id", "x", "y", "row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) - 1L AS cell", "int(phenotype = 't') AS code", "array(40L, 20L) AS n")
    lines = I._tiled(points, ["sample_id"], I.F.lit(1.0), whole=I.F.lit(True)).mapInArrow(*I._counting(points.schema["sample_id"], 5, 1))
    assert lines.count() == 6


def test_pair_modes_and_guards(spark):
    d = spark.createDataFrame(cells(), SCHEMA)
    pairs = lambda **how: {(r.pa, r.pb) for r in I.permutation_scores(d, 1.5, 3, **how).collect()}
    assert pairs(pairs_mode="immune_only") == {(a, b) for a in ("nk", "t") for b in ("nk", "t")}
    assert pairs(pairs_mode="tumor_only") == {("Tumor", "Tumor"), ("Tumor", "nk"), ("Tumor", "t"), ("nk", "Tumor"), ("t", "Tumor")}
    assert {r.sample_id for r in I.permutation_scores(d, 1.5, 3, min_cells=2).collect()} == {1, 2, 4}
    with pytest.raises(ValueError):
        pairs(pairs_mode="all")
