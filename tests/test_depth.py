"""Novelty and depth figures against plain loops."""

import random
from itertools import combinations

from cytoloom.operators import depth


def plain(order, rho, limit, most):
    r = lambda a, b: rho.get((min(a, b), max(a, b)))
    accepted, novel, out = [], {}, []
    for u in order:
        novel[u] = all(r(u, v) is None or abs(r(u, v)) < limit for v in accepted)
        accepted += [u] * novel[u]
    for n in range(1, min(len(order), most) + 1):
        first = order[:n]
        known = [(a, b) for a, b in combinations(first, 2) if r(a, b) is not None]
        high = [(a, b) for a, b in known if abs(r(a, b)) >= limit]
        group = {x: {x} for x in first}
        for a, b in high:
            whole = group[a] | group[b]
            for x in whole:
                group[x] = whole
        new = sum(novel[x] for x in first)
        out.append((n, len(known), len(high), len({x for p in high for x in p}), len({id(g) for g in group.values()}), new, new / n, novel[order[n - 1]]))
    return novel, out


def test_against_plain_loops(spark):
    r = random.Random(5)
    reg, pairs, want, flags = [], [], {}, {}
    for root, n in (("p", 30), ("q", 9), ("one", 1)):
        order = [f"f{i}" for i in r.sample(range(100), n)]
        rho = {(min(a, b), max(a, b)): r.choice([None, round(r.uniform(-1, 1), 3)]) for a, b in combinations(order, 2) if r.random() < 0.7}
        reg += [(root, f, i + 1) for i, f in enumerate(order)]
        pairs += [(root, a, b, x) for (a, b), x in rho.items()]
        flags[root], want[root] = plain(order, rho, 0.6, 20)
    g, p = spark.createDataFrame(reg, "root string, feature string, place int"), spark.createDataFrame(pairs, "root string, a string, b string, rho double")
    assert {(x.root, x.feature): x.novel for x in depth.novelty(g, p, ["root"], 0.6).collect()} == {(k, f): v for k, m in flags.items() for f, v in m.items()}
    got = sorted(tuple(x) for x in depth.depth_diagnostics(g, p, ["root"], 0.6, 20).collect())
    assert got == sorted((k, *x) for k, rows in want.items() for x in rows)


def test_by_hand(spark):
    g = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 3)], "root string, feature string, place int")
    p = spark.createDataFrame([("r", "a", "b", 0.9), ("r", "b", "c", 0.1)], "root string, a string, b string, rho double")
    rows = sorted(tuple(x)[1:] for x in depth.depth_diagnostics(g, p, ["root"], 0.5).collect())
    assert rows == [(1, 0, 0, 0, 1, 1, 1.0, True), (2, 1, 1, 2, 1, 1, 0.5, False), (3, 2, 1, 2, 2, 2, 2 / 3, True)]
