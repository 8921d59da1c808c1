"""Operator 13 against tiktoken and the pattern's own matches."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from cytoloom.llm import byte_bpe

SCHEMA = "doc_id long, text string, lang string, ids long, w int, pos long"


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.coder().ranks, special_tokens={})


def ids(own, text):
    return np.array(own.encode_ordinary(text or ""), "<u4").tobytes()


def test_words_are_the_patterns():
    r = random.Random(3)
    texts = ["".join(r.choice(" \n'strevmldDa1!é \t'") for _ in range(r.randrange(14))) for _ in range(20000)]
    buf, offset, first = byte_bpe.split(texts)
    for k, t in enumerate(texts):
        assert [buf[offset[i] : offset[i + 1]].decode() for i in range(first[k], first[k + 1])] == regex.findall(P.PATTERN, t)


def test_ids_over_code_points(own):
    texts = [f"a{chr(c)}{chr(c)}1 {chr(c)}!" for c in [*range(0, 0xD800, 5), *range(0xE000, 0x30000, 31)]]
    assert byte_bpe.coder().encode(texts) == [ids(own, t) for t in texts]


def test_long_words_and_low_ranks(own):
    """Runs of one letter, and random words of few letters, where merges of a merged token often rank lower than itself."""
    r = random.Random(1)
    words = ["a" * 9000, "x" * 4097, " " * 3000, *("".join(r.choices("abcde", k=400)) for _ in range(10)), *("".join(r.choices("tionse", k=60)) for _ in range(300))]
    assert byte_bpe.coder().encode(words) == [ids(own, w) for w in words]


def test_slices_end_where_words_end():
    text = "ab  cd\n\n'sé " * 50 + "x" * 300 + " y"
    parts = list(byte_bpe.slices(text, 40))
    assert "".join(parts) == text and len(parts) > 10
    assert [w for p in parts for w in regex.findall(P.PATTERN, p)] == regex.findall(P.PATTERN, text)


def test_round_trip(spark, own):
    texts = [None, "", " \n\t ", "One two three.", "One two three.", "a " * 3000, "é\x00ü 'll don't 12 \U0001f600", "x" * 5000]
    rows = [(i, t, None, 7, None, 1) for i, t in enumerate(texts)] + [(None, "null id", None, None, 1, 1), (3, "One two three.", "en", None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = byte_bpe.encode(d)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(encoded).collect()))
    assert got == sorted((i is None, i or 0, len(ids(own, t)) // 4, ids(own, t), (t or "").encode()) for i, t, *_ in rows)
    assert byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0
    null = spark.createDataFrame([(1, None, None)], "doc_id long, n_tokens long, ids binary")
    assert [bytes(r.decoded) for r in byte_bpe.decode(null).collect()] == [b""]


def test_older_words_go(own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 8)
    c = byte_bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"))
    texts = [f"qw{i}zx erty{i % 3} uiop" for i in range(50)]
    assert [c.encode([t])[0] for t in texts] == [ids(own, t) for t in texts]
    assert len(c.known) <= 8 and len(c.older) <= 8
    with pytest.raises(ValueError):
        c.decode([np.array([10**6], "<u4").tobytes()])


def test_query(spark, own, tmp_path):
    spark.createDataFrame([(1, "Hello there, world's end", "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in byte_bpe.query(spark, str(tmp_path)).collect()}
    for i, t in ((1, "Hello there, world's end"), (2, "")):
        assert got[i].ids_sha256 == hashlib.sha256(ids(own, t)).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert got[i].n_tokens == len(own.encode_ordinary(t))
