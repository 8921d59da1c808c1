"""Nearest cells over tiles and growing blocks against all distances."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cytoloom.operators import neighbours

SCHEMA = "sample_id long, cell_id string, x double, y double, phenotype string, pa int, d2 int"


def plain(rows):
    out = Counter()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[2] is not None and r[4] is not None]
        for a in own:
            for lab in {r[4] for r in own}:
                d = [(a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 for b in own if b[4] == lab and b[1] != a[1]]
                if d:
                    out[g, a[4], lab, round(min(d) ** 0.5, 9)] += 1
    return out


def points(seed):
    r = np.random.default_rng(seed)
    rows = []
    for g, n in ((1, 400), (2, 60), (3, 1), (4, 90)):
        xy = r.uniform(0, 100, (n, 2)) if g == 1 else r.normal(0, 1, (n, 2)) ** 3 if g == 2 else np.column_stack([np.arange(n) * 1.5, np.full(n, 2.0)])
        lab = r.choice(["t", "s", "n"], n, p=[0.7, 0.28, 0.02])
        rows += [(g, f"{g}-{i}", float(x), float(y), str(z), 1, 1) for i, ((x, y), z) in enumerate(zip(xy, lab, strict=True))]
    rows += [(1, "rare", 99.0, 1.0, "one", 1, 1), (1, "twin", 50.0, 50.0, "t", 1, 1), (1, "twin2", 50.0, 50.0, "t", 1, 1), (1, "twin3", 50.0, 50.0, "s", 1, 1), (1, "nowhere", None, 3.0, "t", 1, 1), (1, "unnamed", 3.0, 3.0, None, 1, 1)]
    return rows


@pytest.mark.parametrize("tile", [10_000, 70, 15])
def test_against_all_distances(spark, tile):
    rows = points(7)
    got = Counter((r.sample_id, r.pa, r.pb, round(r.distance, 9)) for r in neighbours.nearest_distances(spark.createDataFrame(rows, SCHEMA), tile=tile).collect())
    assert got == plain(rows)


def test_empty(spark):
    assert neighbours.nearest_distances(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_groups_carry_no_ids():
    """Before, a group in one tile gave its cells' ids and places again for each label."""
    pdf = pd.DataFrame({"g": 7, "x": [0.0, 3.0, 0.0], "y": [0.0, 4.0, 1.0], "phenotype": ["s", "t", "s"]})
    got = neighbours._search_whole("g")((7,), pdf)
    assert list(got.columns) == ["g", "pa", "pb", "d2"]
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(7, "s", "s", 1.0), (7, "s", "s", 1.0), (7, "s", "t", 18.0), (7, "s", "t", 25.0), (7, "t", "s", 18.0)]
