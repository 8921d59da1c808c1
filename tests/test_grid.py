"""The grid against one plain run for each cell."""

import random
from collections import defaultdict

from cytoloom.operators import grid as G


def candidates(seed, features=40):
    r = random.Random(seed)
    reg, pairs = [], []
    for panel in "AB":
        for c in range(6):
            names = r.sample(range(200), features)
            reg += [(panel, f"c{c}", n, i + 1) for i, n in enumerate(names)]
            pairs += [(panel, f"c{c}", "k", a, b, round(r.uniform(0.8, 1), 3)) for a in names for b in names if a < b and r.random() < 0.1]
    return reg, pairs


def test_cells_are_prefixes_of_one_run(spark):
    reg, pairs = candidates(1)
    caps, rhos = [1, 5, 10, 25, 40, 60], [0.85, 0.9, 0.97]
    r = spark.createDataFrame(reg, "panel string, context string, feature int, place int")
    p = spark.createDataFrame(pairs, "panel string, context string, key string, a int, b int, rho double")
    got = {(x.cap, x.limit, x.panel, x.context, x.feature) for x in G.cells(G.kept_at(r, p, ["panel", "context"], rhos), caps).collect()}
    want = set()
    rho = {(q[0], q[1], frozenset(q[3:5])): q[5] for q in pairs}
    for cap in caps:
        for lim in rhos:
            stays = defaultdict(list)
            for panel, c, f, place in sorted(reg, key=lambda x: x[3]):
                if place <= cap and not any(rho.get((panel, c, frozenset((f, g))), 0) >= lim for g in stays[panel, c]):
                    stays[panel, c].append(f)
            want |= {(cap, lim, panel, c, f) for (panel, c), fs in stays.items() for f in fs}
    assert got == want and len(want) > 500


def test_support_and_quotas(spark):
    r = random.Random(2)
    rows = [(10, 0.9, "A", f"h{c % 3}", f"h{c % 3}c{c}", r.random() < 0.7, f, r.choice([None, round(r.random(), 2)]), round(r.random(), 2)) for c in range(9) for f in r.sample(range(60), 25)]
    rows += [(10, 0.9, "A", "h1", f"h1x{i}", True, 1000 + f, 0.5, 0.5) for f in range(8) for i in range(2)]
    d = spark.createDataFrame(rows, "cap int, limit double, panel string, cohort string, context string, strong boolean, feature int, score double, oof double")
    s = G.support(d)
    got = {x.feature: x for x in s.collect()}
    by = defaultdict(list)
    for x in rows:
        by[x[6]].append(x)

    def median(v):
        v = sorted(x for x in v if x is not None)
        return None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    med = {f: median([x[7] for x in v]) for f, v in by.items()}
    some = [m for m in med.values() if m is not None]
    pct = {f: None if m is None else (sum(x < m for x in some) + (sum(x == m for x in some) + 1) / 2) / len(some) for f, m in med.items()}
    info = {f: (len({x[4] for x in v}), len({x[3] for x in v}), any(x[5] for x in v), v[0][3]) for f, v in by.items()}
    ok = [f for f, (n, c, strong, _) in info.items() if c == 1 and strong and (n >= 2 or (pct[f] or 0) >= 0.95)]
    none = lambda x: (x is None, -(x or 0))
    chosen, used = [], defaultdict(int)
    for f in sorted(ok, key=lambda f: (-info[f][0], none(pct[f]), none(med[f]), -max(x[8] for x in by[f]), f)):
        if len(chosen) < G.MOST_PER_PANEL and used[info[f][3]] < G.MOST_PER_COHORT:
            chosen.append(f)
            used[info[f][3]] += 1
    assert {f for f, x in got.items() if x.exceptional} == set(chosen) and len(ok) > len(chosen) >= 3
    assert {f for f, x in got.items() if x.s2} == {f for f, x in info.items() if x[1] >= 2}
    (m,) = G.grid_metrics(d, s).collect()
    assert m.n_unique == len(by) and m.n_records == len(rows) and m.n_chosen == len(set(chosen) | {f for f, x in info.items() if x[1] >= 2})
    assert m.single == max(sum(x[1] == 1 and x[3] == h for x in info.values()) for h in ("h0", "h1", "h2")) / len(by)
