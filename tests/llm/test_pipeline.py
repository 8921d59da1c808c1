"""Decontamination and the pipeline's stages."""

import hashlib
import random

import corpus_pipeline
from cytoloom.llm import decontamination as D

from .test_ngram_join import brute as linked
from .test_suffix_dedup import brute as spans

EN = "the of and that with her was ing not for are this have from they been would which".split()


def sentence(r, n):
    return " ".join(r.choice(EN) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(n))


def tables(spark, tmp_path):
    r = random.Random(5)
    items = [(i, sentence(r, r.randint(12, 40)).capitalize() + ".") for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, "What is nitrous oxide?"), (94, "the of")]
    docs = [(i, sentence(r, r.randint(30, 300)), "en", "s", 0, 0.5) for i in range(60)]
    leaks = {}
    for k in range(12):
        words = items[k][1].split()
        if k % 3 == 1:  # a paraphrase: words lost and put in
            words = [w for j, w in enumerate(words) if j % 9 != 4]
            words.insert(len(words) // 2, "zzz")
        text = f"{sentence(r, 25)} {' '.join(words).upper() if k % 3 == 2 else ' '.join(words)} {sentence(r, k)}"
        docs.append((100 + k, text, "en", "s", 0, 0.1))
        leaks[100 + k] = k
    docs += [(200, docs[0][1], "en", "s", 0, 0.0), (201, docs[1][1] + " tail", None, None, None, None), (202, docs[2][1][:400] + sentence(r, 80), "en", "s", 7, None), (203, None, "en", None, None, None), (204, "", None, None, None, None), (205, "1 2 3", "en", "s", 1, 1.0), (0, docs[0][1], "en", "s", 0, 0.5), (206, items[0][1], "en", "s", 0, 0.5)]
    leaks[206] = 0
    docs += [(207, sentence(r, 40) + " so, what is NITROUS oxide " + sentence(r, 9), "en", "s", 0, 0.5), (208, "The of!", "en", "s", 1, 0.5), (209, "the of the", "en", "s", 1, 0.5)]
    leaks |= {207: 93, 208: 94}
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, cosine double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return leaks


def test_decontamination(spark, tmp_path):
    leaks = tables(spark, tmp_path)
    docs, bench = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "benchmark"))
    for block in (500_000, 60):
        assert {r.doc_id: r.item_id for r in D.leaks(docs, bench, block).collect()} == leaks
    assert D.leaks(docs.where("false"), bench).count() == 0 and D.leaks(docs, bench.where("false")).count() == 0


def planted(seed, n_items=40):
    """Items hidden in other words, by kind of edit."""
    r = random.Random(seed)
    items = [sentence(r, r.randint(15, 40)).split() for _ in range(n_items)]
    other = sentence(r, 3000).split()

    def edit(words, share):
        out = []
        for w in words:
            x = r.random()
            out += [r.choice(other)] if x < share / 2 else [] if x < share else [w]
        return out

    swap = lambda w: w[len(w) // 2 :] + w[: len(w) // 2]
    kinds = {"exact": lambda w: w, "30 % edited": lambda w: edit(w, 0.3), "halves swapped": swap, "swapped, 10 % edited": lambda w: edit(swap(w), 0.1)}
    docs, truth = [], {}
    for kind, f in kinds.items():
        for i, w in enumerate(items):
            at = r.randint(0, 240)
            hay = [r.choice(other) for _ in range(240)]
            truth[len(docs)] = (kind, i)
            docs.append((len(docs), " ".join(hay[:at] + f(w) + hay[at:])))
    docs += [(len(docs) + i, " ".join(r.choice(other) for _ in range(r.randint(20, 300)))) for i in range(60)]
    return [" ".join(w) for w in items], docs, truth


def test_recall_by_kind_of_edit(spark):
    items, docs, truth = planted(7)
    hits = {(h.doc_id, h.item_id) for h in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for kind in {k for k, _ in truth.values()}:
        of = [(d, i) for d, (k, i) in truth.items() if k == kind]
        assert sum(x in hits for x in of) >= (1 if kind == "exact" else 0.9) * len(of), kind
    assert hits <= {(d, i) for d, (_, i) in truth.items()}


def test_search_against_brute_force(spark):
    """Every window at every place, without the latent space: what the query finds is there, and of what is there it finds nine tenths or more."""
    import numpy as np

    items, docs, _ = planted(8, 6)
    bench = D.Benchmark([(i, t.encode()) for i, t in enumerate(items)])
    terms = [bench.number(D.words_of([t.encode()]).hash()) for _, t in docs]
    lots = [t[a : a + D.PASSAGE] for t in terms for a in range(0, len(t), D.PASSAGE)]
    df = np.bincount(np.concatenate([np.unique(x[x > 0]) for x in lots]), minlength=len(bench.vocabulary) + 1)
    idf = np.log((1 + len(lots)) / (1 + df)) + 0.1
    want = set()
    for d, t in enumerate(terms):
        for i, item in bench.items:
            share = {x: idf[x] / idf[np.unique(item)].sum() for x in np.unique(item)}
            for a in range(0, len(t), 2):
                text = t[a : a + len(item) * 3 // 2]
                if sum(share.get(x, 0) for x in set(text.tolist())) < D.ANSWER:
                    continue
                for alike, least in ((D.lcs, D.SUBSEQUENCE), (D.in_parts, D.IN_PARTS)):
                    n, p, q = alike(item, text)
                    if n >= least * len(item) and sum(share.get(x, 0) for x in set(text[p:q].tolist())) >= D.ANSWER:
                        want.add((d, i))
    hits = {(h.doc_id, h.item_id) for h in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) >= 20 and hits <= want and len(hits) >= 0.9 * len(want)


def test_rows_with_a_null_id_are_cleaned(spark):
    items, docs, truth = planted(9, 5)
    d = spark.createDataFrame([(None, t, 1) for _, t in docs], "doc_id long, text string, _key int")
    left = [r.text for r in D.clean(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()]
    gone = [t for i, t in docs if i in truth and truth[i][0] == "exact"]
    assert not set(gone) & set(left) and all(t in left for i, t in docs if i not in truth)


def test_weights_count_a_term_once_a_passage(spark):
    """Narrow and wide numbers, passages cut short by a document's end, empty documents. The bounds take the item's numbers where they stand (before, two lookups a word)."""
    import numpy as np

    r = np.random.default_rng(6)
    texts = [r.integers(0, 9, n) for n in (0, 1, 31, 32, 33, 200, 0, 64)]
    df, n = np.zeros(10), 0
    for t in texts:
        for a in range(0, len(t), D.PASSAGE):
            n += 1
            df[np.unique(t[a : a + D.PASSAGE])] += 1
    want = np.log((1 + n) / (1 + df)) + 0.1
    want[0], want[9] = 0, want[1:9].max()
    for wide in (False, True):
        terms = spark.createDataFrame([(i, bytearray(t.astype("<u4" if wide else "<u2").tobytes())) for i, t in enumerate(texts)], "doc_id long, terms binary").repartition(2)
        assert np.allclose(D.weights(terms, 9, wide), want)
    numbers, count, weight = np.array([1, 0, 2, 2, 1, 0, 0], np.uint8), np.array([1, 3]), np.array([0.25, 0.75])
    overlap, share = D._common(numbers, np.array([0, 1, 5]), np.array([5, 4, 7]), count, weight)
    assert overlap.tolist() == [3, 2, 0] and share.tolist() == [1.0, 0.75, 0.0]


def test_common_words_among_foreign_ones_are_found(spark):
    words = "the of and that with her was ing not for are".split()
    foreign = lambda i, n: " ".join(f"x{i}q{k}" for k in range(n))
    plant = [(i, f"{foreign(i, 20)} {' '.join(words)} {foreign(i + 500, 20)}") for i in range(3)]
    other = [(10 + i, " ".join([*reversed(words), foreign(10 + i, 21)] * 3)) for i in range(400)]
    docs = spark.createDataFrame(plant + other, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert sorted((r.doc_id, r.lcs) for r in D.leaks(docs, bench).collect()) == [(0, 11), (1, 11), (2, 11)]


def test_bit_parallel_lcs():
    import numpy as np

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(1, 30))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and x else max(t[i][j + 1], t[i + 1][j])
        assert D.lcs(np.array(a), np.array(b))[0] == t[-1][-1]


def test_near_duplicates_take_five_words_and_80_percent(spark):
    words = [f"w{i}" for i in range(200)]
    near = [f"x{i}" if i in (30, 80, 120, 160) else w for i, w in enumerate(words)]  # 5-word Jaccard 176/216, 4-word 181/213
    far = [f"y{i}" if i in (30, 60, 90, 120, 150) else w for i, w in enumerate(words)]  # 5-word Jaccard 171/221
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == [1, 3]


def test_stages(spark, tmp_path):
    tables(spark, tmp_path)
    d, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    a = stages["language_id"](spark, d, sf)
    assert a.columns == d.columns and sorted(r.doc_id for r in d.collect()) == sorted([r.doc_id for r in a.collect()] + [203, 204, 205])
    b = stages["ngram_jaccard_join"](spark, a, sf)
    rows = [(r.doc_id, r.text) for r in a.collect()]
    assert b.columns == d.columns and sorted(r.doc_id for r in b.collect()) == sorted({c for _, _, c, _ in linked(rows, 5, 80)})
    c = stages["suffix_array_dedup"](spark, b, sf)
    got, before = {r.doc_id: r for r in c.collect()}, {r.doc_id: r for r in b.collect()}
    for i, n, gone, _, digest in spans([(i, r.text.encode()) for i, r in before.items()]):
        if n == gone:
            assert i not in got
            continue
        assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest and (gone == 0 or got[i].n_chars == n - gone)
        assert got[i].source == before[i].source and got[i].cosine == before[i].cosine
    e = stages["benchmark_decontamination"](spark, c, sf)
    left = {r.doc_id for r in e.collect()}
    assert left == set(got) - {r.doc_id for r in D.leaks(c, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert e.columns == d.columns and not left & set(range(100, 112))
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == left and left
    empty = d.where("false")
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf).count() == 0, name
