import hashlib
import random

import pytest

from cytoloom.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for i, t in rows:
        k = S.LAST if i is None else i
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            first[w] = min(first.get(w, k), k)
    out = []
    for i, t in rows:
        k = S.LAST if i is None else i
        c = bytearray(len(t))
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < k:
                c[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        runs = len([x for x in bytes(c).split(b"\0") if x])
        out.append((i, len(t), sum(c), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abé ") for _ in range(n))
    shared = [piece(n) for n in (30, 49, 50, 51, 70, 120, 400)]
    loop = piece(7) * 40
    texts = [None, "", "short", piece(3000), loop, loop + piece(20), shared[6], shared[6], "x" * 500, "x" * 80]
    for _ in range(60):
        t = "".join(r.choice([piece(r.randint(1, 90)), r.choice(shared), r.choice(shared)[r.randint(0, 20) :]]) for _ in range(r.randint(1, 8)))
        texts.append(t)
    base = piece(900)
    for _ in range(20):
        p = r.randrange(850)
        texts.append(base[:p] + "#" + base[p + r.randint(0, 30) :])
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return [*rows, (None, shared[6]), (None, shared[6]), (12, shared[6] + "z"), (12, shared[5])]


@pytest.mark.parametrize(("seed", "how"), [(1, {"chunk_bytes": 4000, "batches": 5}), (2, {"batches": 1})])
def test_against_brute_force(spark, seed, how):
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, 3, b"") for i, t in rows], "doc_id long, text string, chunk int, ids binary").repartition(4)
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert sorted((tuple(r) for r in S.digests(d, **how).collect()), key=repr) == want


def test_scan_in_small_steps():
    """A bucket's merge scan gives the same rows however its input is cut."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    n = 3000
    level = r.random(n) < 0.4
    cols = {"gram": r.integers(0, 40, n), "whole": r.integers(0, 30, n), "doc": np.where(level, S.EARLIER, r.integers(0, 9, n)), "chunk": np.where(level, 1, 5 << S._BATCH), "spot": np.arange(n), "sides": r.integers(0, 3, n) << 16 | r.integers(0, 3, n)}
    rows = sorted(zip(*(c.tolist() for c in cols.values()), strict=True))
    seen, keep = set(), []
    for x in rows:  # a level holds an entry once
        if x[3] != 1 or x[:2] not in seen:
            keep.append(x)
        if x[3] == 1:
            seen.add(x[:2])
    t = pa.table({k: pa.array(v, pa.int32() if k in ("gram", "sides") else pa.int64()) for k, v in zip(cols, zip(*keep, strict=True), strict=True)})
    found = []
    for size, rows_at_once in ((7, 5), (100, 300), (5000, 10000)):
        out = S._scan(5, rows_at_once)(iter(t.to_batches(max_chunksize=size)))
        found.append(sorted(tuple(y.values()) for b in out for y in b.to_pylist()))
    assert found[0] == found[1] == found[2] and {x[5] for x in found[0]} == {0, 1, 2, 3}


def test_a_family_outlives_its_session(spark):
    """Batches added one by one, each by a session that opens the index anew, give what one run over all of them gives; levels stay few."""
    rows = sorted([(i, t) for i, t in corpus(5) if i is not None], key=lambda x: x[0])
    cuts = [0, 15, 30, 31, 60, len(rows)]
    cuts = [next((k for k in range(c, len(rows)) if k == 0 or rows[k][0] != rows[k - 1][0]), len(rows)) for c in cuts[:-1]] + [len(rows)]
    path, got = S.Family(spark).path, []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        s = spark.newSession()
        family = S.Family.open(s, path) if k else S.Family(s, path)
        got += [tuple(r) for r in S.digests(s.createDataFrame(rows[a:b], "doc_id long, text string"), batches=1, chunk_bytes=3000, family=family).collect()]
        sizes = [n for _, n in family.levels]
        assert all(x >= 2 * y for x, y in zip(sizes[:-1], sizes[1:-1], strict=False))
    assert sorted(got, key=repr) == brute([(i, (t or "").encode()) for i, t in rows])
    assert len(S.Family.open(spark, path).levels) <= 4


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(d).count() == 0 and S.deduplicate(d).count() == 0


def test_a_very_long_text_and_clashing_columns(spark):
    long = "".join(f"line {i} of a long text;" for i in range(120_000))
    d = spark.createDataFrame([(1, long, "a", 1, b"x"), (2, long[1_000_000:2_000_000] + "tail", "b", 2, b"y")], "doc_id long, text string, spots string, batch int, rest binary")
    assert [tuple(r) for r in S.rewrite(d).orderBy("doc_id").collect()] == [(1, long, "a", 1, b"x"), (2, "tail", "b", 2, b"y")]
