"""Concordance from blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import models


def plain(rows):
    won = pairs = 0
    for t, e, s in rows:
        if e:
            for u, _, v in rows:
                if t < u:
                    pairs += 1
                    won += 1.0 if s > v else 0.5 if s == v else 0.0
    return (won / pairs, pairs) if pairs else None


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_against_all_pairs(spark, blocks):
    r = np.random.default_rng(blocks)
    kinds = {"spread": (r.normal(size=150), r.normal(size=150)), "ties": (r.integers(0, 6, 150), r.integers(0, 4, 150)), "hot": (np.where(r.random(150) < 0.5, 3.0, r.normal(3, 1, 150)), np.where(r.random(150) < 0.5, 0.0, r.normal(size=150))), "one": (np.ones(20), r.normal(size=20)), "lone": (np.ones(1), np.ones(1))}
    rows = [(k, float(t), bool(r.random() < 0.6), float(s), 1) for k, (ts, ss) in kinds.items() for t, s in zip(ts, ss, strict=True)]
    odd = [("spread", None, True, 1.0, 1), ("spread", 1.0, None, 1.0, 1), ("spread", 1.0, True, None, 1), ("spread", float("nan"), True, 1.0, 1)]
    d = spark.createDataFrame(rows + odd, "kind string, time double, event boolean, risk double, tb int").repartition(4)
    got = {x.kind: (x.c_index, x.n_pairs) for x in models.concordance(d, ["kind"], "risk", blocks).collect()}
    want = {k: p for k in kinds if (p := plain([x[1:4] for x in rows if x[0] == k]))}
    assert set(got) == set(want) == {"spread", "ties", "hot"}
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


def test_blocks_that_change_from_run_to_run(spark, monkeypatch):
    """Quantiles are approximate and may follow the order of partial results: all counts must use those of one run."""
    r = np.random.default_rng(8)
    rows = [("k", float(t), bool(e), float(s)) for t, e, s in zip(r.normal(size=300), r.random(300) < 0.6, r.normal(size=300), strict=True)]
    shaken = F.udf(lambda a: sorted({x + float(np.random.default_rng().normal(0, 0.2)) for x in a}), "array<double>").asNondeterministic()
    plainly = F.percentile_approx
    monkeypatch.setattr(models.F, "percentile_approx", lambda *a: shaken(plainly(*a)))
    x = models.concordance(spark.createDataFrame(rows, "kind string, time double, event boolean, risk double"), ["kind"], "risk", 4).first()
    want = plain([y[1:] for y in rows])
    assert (x.c_index, x.n_pairs) == (pytest.approx(want[0]), want[1])
