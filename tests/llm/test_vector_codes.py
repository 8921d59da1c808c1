"""Operator 11 against plain loops with Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from cytoloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int, rows long"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label), all kept, ids in order."""
    q = [[math.floor(Fraction(x) * 4096) for x in v] for _, v, _ in rows]
    w = len(q[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in q]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [[near(p, c[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own[p], strict=True) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in x) for x in last]
    label = {lab: sum(e for e, r in zip(error, rows, strict=True) if r[2] == lab) for lab in {r[2] for r in rows}}
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    small = lambda x: x if x < 1 << 63 else None
    return [(r[0], "".join(f"{i:02x}" for _, i in x), small(e), small(label[r[2]]), digest) for r, x, e in zip(rows, last, error, strict=True)]


def run(spark, rows, **how):
    d = spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.compress(d, **how).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def f32(x):
    return np.asarray(x, np.float32).tolist()


@pytest.mark.parametrize("n, dim", [(5, 8), (40, 16), (300, 32)])
def test_against_plain_loops(spark, n, dim):
    r = np.random.default_rng(n)
    rows = [(i * 3, f32(r.normal(size=dim)), [None, 1, 2][i % 3]) for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_ties_and_copies(spark):
    """Few values, so that many entries are equal or equally far."""
    r = np.random.default_rng(2)
    rows = [(i, f32(r.integers(-2, 3, 16) / 4096), None) for i in range(120)] + [(200 + i, f32([0.5] * 16), 7) for i in range(60)]
    assert run(spark, rows) == plain(rows)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, f32(r.normal(size=8) * 10.0 ** (i % 30)), i % 2) for i in range(60)]
    assert run(spark, rows) == plain(rows)


def test_rows_that_go(spark):
    good = [(i, f32([i, 1, 2, 3, 4, 5, 6, -i]), 1) for i in range(20)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [1.0, None] + [0.0] * 6, 1), (-4, [math.nan] + [0.0] * 7, 1), (-5, [math.inf] + [0.0] * 7, 1), (-6, [1.0] * 12, 1), (30, [1.0] * 16, 1)]
    assert run(spark, good + bad) == plain(good)
    assert run(spark, bad[:5]) == [] and run(spark, []) == []
    twice = [*good, (3, f32([9] * 8), 1), (None, f32([1] * 8), None)]
    got = run(spark, twice)
    assert len(got) == 22 and got[-1][0] is None and got[-1][2] == got[-1][3]


def test_trees_visit_equal_distances():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, dim = int(r.integers(1, 40)), int(r.integers(1, 5))
        book, rows = r.integers(-6, 7, (n, dim)), r.integers(-9, 10, (50, dim))
        index, d = V.nearest(V.grow(book, list(range(n))), book, rows)
        every = ((rows[:, None] - book[None]) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (d == every.min(1)).all()


def test_rare_and_common_labels(spark, monkeypatch):
    monkeypatch.setattr(V, "HOT", 4)
    r = np.random.default_rng(5)
    rows = [(i, f32(r.normal(size=8)), [None, 1, 1, i][i % 4]) for i in range(80)]
    assert run(spark, rows) == plain(rows)
