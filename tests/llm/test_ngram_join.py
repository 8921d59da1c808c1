import random

import pytest

from cytoloom.llm import ngram_join as J


def brute(rows, size=4, threshold=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    count = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                count[i] += 1
                count[j] += 1
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None, count[i]))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    passage = text(60)
    docs = [None, "", "  \t", "One", "one", "a b c", "A B C", "a b c d", "a b\x0bc\nd", "x " * 500, "x " * 700]
    for n in (20, 60, 200):
        for _ in range(6):
            base = text(n)
            docs.append(" ".join(base))
            for _ in range(r.choice([1, 3, 14])):
                b = list(base)
                for _ in range(r.randint(0, max(1, n // 30))):
                    p = r.randrange(len(b))
                    b[p : p + r.randint(0, 2)] = text(r.randint(0, 2))
                docs.append(" ".join(b))
    book = [f"v{r.randrange(9000)}" for _ in range(2500)]  # long texts: wide bitmaps
    for k in (0, 0, 3, 40, 160, 240, 300, 420, 700):
        b = list(book)
        for _ in range(k):
            b[r.randrange(len(b))] = f"u{r.randrange(9000)}"
        docs.append(" ".join(b[: r.randint(2300, 2500)]))
    chain = text(150)  # a chain whose ends do not link
    for _ in range(25):
        chain = [*chain[3:], *text(3)]
        docs.append(" ".join(chain))
    for _ in range(30):
        docs.append(" ".join(text(r.randint(5, 40)) + passage + text(r.randint(0, 10))))
    rows = [(i, d) for i, d in enumerate(docs)]
    r.shuffle(rows)
    return [*rows, (None, "a b c d"), (None, "q r s t u"), (3, "One"), (7, "a b c d")]


@pytest.mark.parametrize(("seed", "counters", "entries", "shingles", "size", "threshold"), [(1, 1 << 22, 1 << 19, 200_000, 4, 85), (2, 1 << 6, 40, 300, 5, 80)])
def test_against_brute_force(spark, seed, counters, entries, shingles, size, threshold, monkeypatch):
    """Components and counts of links, also with lists and components cut in small parts."""
    monkeypatch.setattr(J.frequency_classes, "__defaults__", (counters,))
    monkeypatch.setattr(J._lists, "__defaults__", (threshold, entries))
    monkeypatch.setattr(J, "TILE_SHINGLES", shingles)
    rows = corpus(seed)
    d = spark.createDataFrame([(i, t, 1, b"", 2) for i, t in rows], "doc_id long, text string, n int, bits binary, comp int").repartition(4)
    got = sorted((tuple(r) for r in J.cluster(d, size, threshold).collect()), key=repr)
    assert got == brute(rows, size, threshold)


def test_one_of_each(spark):
    """One row of each component stays; rows of one id with unlike texts are unlike rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, 0), (1, b, 1), (1, b, 1), (2, a + " tail", 2), (3, None, 3), (3, None, 3), (4, "", 4), (None, c, 5), (None, c, 5), (None, b + " end", 6), (7, "short", 7), (8, "SHORT", 8), (9, c.upper() + " more", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(3)
    got = sorted((tuple(r) for r in J.one_of_each(d).collect()), key=repr)
    assert got == sorted([(1, a, 0), (1, b, 1), (3, None, 3), (3, None, 3), (4, "", 4), (7, "short", 7), (9, c.upper() + " more", 9)], key=repr)
    assert J.one_of_each(spark.createDataFrame([(None, c, 1)] * 3, "doc_id long, text string, k int")).count() == 1


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    d = spark.createDataFrame([(1, long), (2, long + " tail"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in J.cluster(d).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(50)]
    got = {x.node: x.comp for x in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1
    assert all(got[a] == got[b] for a, b in edges if a != b)
    parent = {n: n for e in edges for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({root(n) for n in got}) == len(set(got.values()))


def test_empty(spark):
    assert J.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("size", "threshold"), [(4, 85)])
def test_every_link_is_given(spark, size, threshold):
    rows = corpus(1)
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs, of = J.links(d, size, threshold)
    got = pairs.collect()
    different = list(set(sets))
    meets = lambda x, y: bool(x and y) and 100 * len(x & y) >= threshold * len(x | y)
    assert len(got) == len(set(got)) == sum(meets(x, y) for i, x in enumerate(different) for y in different[:i])
    assert of.count() == sum(bool(s) for s in sets) and of.select("node").distinct().count() == len(set(sets) - {frozenset()})


@pytest.mark.parametrize("threshold", [10, 30, 50, 80, 85, 100])
def test_lengths_of_sets_that_may_link(threshold):
    """No two sizes that may link have bitmaps whose lengths are told apart."""
    length = lambda n: 1 << (2 * n - 1).bit_length()
    sizes = [n for k in range(1, 12) for n in (2**k - 1, 2**k, 2**k + 1, 3 * 2**k // 2)]
    for a in sizes:
        for b in sizes:
            if 100 * min(a, b) >= threshold * max(a, b):
                assert not J._apart(length(a), length(b), threshold)
    assert J._apart(64, 256, 80) and not J._apart(64, 128, 80) and not J._apart(1024, 4096, 30)
