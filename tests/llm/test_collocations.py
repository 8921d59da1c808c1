"""Operator 12 against counters of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cytoloom.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, w1 string, n long, size int"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def plain(rows, max_n=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for ws in pieces(text):
            n[lang] += len(ws)
            for i in range(len(ws)):
                for m in range(1, min(max_n, len(ws) - i) + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(x == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (x, q), b in cand.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), left, right, n[lang]))
    got, rank = [], Counter()
    for lang, s, a, p, left, right, total in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), -a, left, right, total, -s))
    return got


def run(spark, rows, **how):
    d = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in C.collocations(d, **how).collect())


def corpus(seed, docs=150):
    r = random.Random(seed)
    words = ["The", "of", "a\x01", "A", "é", "x\x01y", "\x00", "new", "York", "city", "　b", *(f"w{i}" for i in range(20))]
    odds = [200, 80, 30, 30, 20, 20, 10, 60, 60, 40, 10] + [8] * 20
    text = lambda: "".join(w + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " new york city "]) for w in r.choices(words, odds, k=r.randrange(60)))
    return [(r.choice([text(), None, "", " \n ", "the of " * 50]), r.choice(["en", "en", "en", "fr", None])) for _ in range(docs)]


@pytest.mark.parametrize("how", [{}, {"max_n": 4, "least": 5, "cover": 30, "top": 7}, {"max_n": 2, "least": 2}])
def test_against_counters(spark, how):
    rows = corpus(len(how)) * 2
    got = run(spark, rows, **how)
    assert got and got == sorted(plain(rows, **how))


def test_hot_prefixes_are_split(spark, monkeypatch):
    """Nearly every prefix is hot and counted in part by several tasks."""
    monkeypatch.setattr(C, "SHARE", 30)
    rows = [("the cat sat. the cat ran. the the the", "en")] * 30 + [("the cat sat", "fr")] * 9 + corpus(9, 60)
    d = spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    hot = C.hot_prefixes(d)
    assert b"en\xffthe " in hot and b"en\xffthe cat " in hot
    assert run(spark, rows) == sorted(plain(rows))


def test_hot_keys_go_apart():
    w = C.Words([b"the a. the b. the c c. the d. of a. of b"], pa.array(["en"]), 3)
    first, _ = w.distinct(3)
    words = [k.as_py() for k in w.keys(first, 3)]
    cold, split = C._dealt(w, first, set(), 1 << 30), C._dealt(w, first, {b"en\xffthe "}, 1 << 30)
    the = [i for i, k in enumerate(words) if k.startswith(b"en\xffthe ")]
    of = [i for i, k in enumerate(words) if k.startswith(b"en\xffof ")]
    assert len({cold[i] for i in the}) == 1 and len({split[i] for i in the}) == 4 and len({split[i] for i in of}) == 1


def test_stack_over_any_batches():
    r = random.Random(4)
    rows = sorted(((r.choice("xy"), *[r.choice(["a", "a\x01", "ab", "é"]) for i in range(m)], r.randrange(1, 4)) for m in r.choices([1, 2, 3], k=400)), key=str, reverse=True)
    want = Counter()
    for lang, *ws, n in rows:
        for i in range(len(ws) + 1):
            want[lang.encode() + C.END_LANG + b"".join(w.encode() + b" " for w in ws[:i])] += n
    keys = sorted(((lang.encode() + C.END_LANG + b"".join(w.encode() + b" " for w in ws), n) for lang, *ws, n in rows), reverse=True)
    for _ in range(40):
        stack, got, at = C.Stack(3, 1, set()), Counter(), 0
        while at < len(keys):
            part = keys[at : at + r.randrange(1, 60)]
            at += len(part)
            b = pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int32())], ["key", "n"])
            for k, n in zip(*stack.push(*C._columns([b.slice(0, 1), b.slice(1)])), strict=True):
                got[k] += n
        for k, n in zip(*stack.finish(), strict=True):
            got[k] += n
        assert got == want


def test_common_prefixes():
    r = random.Random(6)
    keys = sorted(bytes(r.choices(b"ab\xff", k=r.randrange(1, 40))) for _ in range(500))
    size = np.array([len(k) for k in keys])
    got = C._common(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [0, *(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(keys, keys[1:]))]


def test_empty_and_rare(spark):
    assert run(spark, []) == [] and run(spark, [(None, "en"), ("", None)]) == [] and run(spark, [("one two " * 9, "en")]) == []
    long = [("alpha beta " * 60000, "en")]
    assert run(spark, long) == sorted(plain(long))
