"""Sums and best ones over pairs against plain loops, and over keys whose pairs can't be rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import joins, programs


def test_gaps(spark):
    r = np.random.default_rng(2)
    rows = [("x", int(i), float(v)) for i, v in zip(r.integers(0, 60, 90), r.integers(0, 20, 90) / 8, strict=True)]
    rows += [("x", 3, None), ("x", None, 1.0), (None, 1, 1.0), ("lone", 1, 1.0), ("same", 1, 1.0), ("same", 1, 2.0), ("void", 1, None), ("void", 2, 1.0)]
    got = {x.k: (x.n_pairs, x.gap) for x in joins.pair_gaps(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    pairs = [(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] == "x" and a[1] is not None and b[1] is not None and a[1] < b[1]]
    assert got == {"x": (len(pairs), pytest.approx(sum(abs(a - b) for a, b in pairs if a is not None and b is not None))), "void": (1, None)}


def test_gaps_of_a_long_key(spark):
    n = 300_000
    got = joins.pair_gaps(spark.range(n).selectExpr("1 AS k", "id AS i", "CAST(id AS double) AS v"), ["k"], "i", "v").first()
    assert (got.n_pairs, got.gap) == (n * (n - 1) // 2, pytest.approx(n * (n * n - 1) / 6))


def test_rescues(spark):
    r = np.random.default_rng(4)
    rows = [(str(c), str(s), i, int(t), float(v)) for i, (c, s, t, v) in enumerate(zip(r.integers(0, 2, 120), r.integers(0, 2, 120), r.integers(0, 4, 120), r.integers(0, 12, 120) / 20, strict=True))]
    rows += [("0", "0", 200, 0, None), ("0", "0", 201, None, 0.9), (None, "0", 202, 0, 0.9), ("0", "0", 5, 3, 0.2)]
    got = {(x.c, x.i, x.simpler) for x in joins.rescues(spark.createDataFrame(rows, "c string, s string, i int, t int, v double"), ["c", "s"], "i", "t", "v", 2, 0.05, "c").collect()}
    want = set()
    for key in {(a[0], a[2]) for a in rows}:
        ok = [b for a in rows if (a[0], a[2]) == key for b in rows if a[0] is not None and a[:2] == b[:2] and None not in (a[3], b[3], a[4], b[4]) and b[3] < a[3] and round(a[4] - b[4], 6) <= 0.05]
        want |= {(*key, b[2]) for b in sorted(ok, key=lambda b: (-b[4], b[2]))[:2]}
    assert got == want


def test_rescues_of_a_long_key(spark):
    d = spark.range(200_000).selectExpr("'c' AS c", "'s' AS s", "id AS i", "id % 2 AS t", "0.5D AS v")
    got = joins.rescues(d, ["c", "s"], "i", "t", "v", 2, 0.05, "c")
    assert got.count() == 200_000 and {x.simpler for x in got.select("simpler").distinct().collect()} == {0, 2}


@pytest.mark.parametrize("block", [1, 7, 256])
def test_means_inside_modules(spark, block):
    r = np.random.default_rng(5)
    rows = [(str(a), int(b), int(c)) for a, b, c in zip(r.integers(0, 2, 150), r.integers(0, 3, 150), r.integers(0, 90, 150), strict=True)]
    d = spark.createDataFrame([*rows, ("lone", 0, 1), (None, 0, 1), ("0", 0, None)], "root string, module int, feature long")
    rho = lambda a, b: (a * 3 + b * 7) % 10 - 5
    got = {(x.root, x.module): x.mean_abs_rho for x in programs.mean_inside_by_kind(d, F.col("feature") % 10, rho, block=block).collect()}
    want = {}
    for k in {x[:2] for x in rows}:
        f = [x[2] for x in rows if x[:2] == k]
        want[k] = np.mean([abs(rho(a, b)) for a in f for b in f if a < b])
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)


def test_means_inside_a_long_module(spark):
    d = spark.range(100_000).selectExpr("'r' AS root", "1 AS module", "id AS feature")
    got = programs.mean_inside_by_kind(d, F.col("feature") % 2, lambda a, b: a + 2 * b).first().mean_abs_rho
    n = np.arange(100_000) % 2
    later = np.arange(100_000)[::-1]
    assert got == pytest.approx(((n * later).sum() + 2 * (n * np.arange(100_000)).sum()) / (100_000 * 99_999 / 2))
