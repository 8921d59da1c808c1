"""Operators 1, 3, 4, 5, 6, 8 and 10 against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cytoloom.llm import chat_quotes, language_id, licence_scan, packing, quality_rules, token_counts, warc
from cytoloom.llm.base import ByteWords, encoding

TEXTS = [None, "", "  \n\t ", "One two three.", "One two three.", "a " * 3000, "x" * 9000, "éà ü\x85y <|endoftext|> 'll", "l1 b c d\nl1 b c d\n\nl1 b c d", "The MIT License\nReleased under the MIT License.\nrest"]
SCHEMA = "doc_id long, text string, lang string, score double, part int, n long"


def docs(spark, texts=TEXTS):
    rows = [(i, t, ["en", None][i % 2], 0.5, 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", "en", None, None, 1), (3, texts[3] if len(texts) > 3 else "", "en", None, None, 1)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(text):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_encoding_is_the_tokenizers_one():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [f"ab{chr(c)} {chr(c)}c1{chr(c)}2! {chr(c)}{chr(c)} 's" for c in [*range(0, 0xD800, 3), *range(0xE000, 0x20000, 17)]]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|EndOfText|>", "  <|endoftext|>  's", "<<|endoftext|>>", "<|endof<|endoftext|>text|>"]
    for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.ids == encoding()(s).tolist()


@pytest.mark.parametrize("length", [64, 2048])
def test_packing_round_trip(spark, length):
    d = docs(spark).repartition(3)
    tokens = packing.encode(d)
    got = packing.pieces(tokens, length).collect()
    seqs = {r[0]: np.frombuffer(r[1], "<u4") for r in packing.sequences(tokens, length).collect()}
    want = Counter(tuple(ids(r.text) + [1]) for r in d.collect())
    whole, at = {}, Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
        piece = seqs[r.sequence_id][r.offset : r.offset + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
    assert all(at[s] == length for s in list(at)[:-1]) and sorted(at) == list(range(len(at)))
    assert sum(at.values()) == sum(len(k) * n for k, n in want.items())
    for i, t in enumerate(TEXTS):
        if i != 3:
            mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in mine for x in seqs[r.sequence_id][r.offset : r.offset + r.length]] == ids(t) + [1]
            assert {r.doc_tokens for r in mine} == {len(ids(t)) + 1}
    del whole
    assert packing.pieces(packing.encode(empty(spark)), length).count() == 0


def test_length_histogram(spark):
    d = docs(spark)
    n = Counter(len(ids(r.text)) for r in d.collect())
    h = token_counts.histogram(d)
    got = {r.length: r for r in h.collect()}
    assert {k: r.n_docs for k, r in got.items()} == n
    for k, r in got.items():
        assert r.docs_at_least == sum(c for x, c in n.items() if x >= k)
        assert r.tokens_at_least == sum(x * c for x, c in n.items() if x >= k)
        assert r.truncated_tokens == sum(min(x, k) * c for x, c in n.items())
        assert r.quantile == pytest.approx(sum(c for x, c in n.items() if x <= k) / n.total())
    limits = [0, 1, 5, 100, 3000, 10**6, *n]
    for r in token_counts.truncated_total(h, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) * c for x, c in n.items())
        assert r.docs_cut == sum(c for x, c in n.items() if x > r.context_limit)
    assert token_counts.histogram(empty(spark)).count() == 0


def test_byte_words():
    texts = [b"", b" a b\tc", b"a b c ", b"\xc2\x85 \xc2\xa0x"]
    w = ByteWords(texts)
    words = [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)]
    assert words == [x for t in texts for x in t.split()]
    h = dict(zip(words, w.hash(), strict=True))
    assert len(set(h.values())) == len(h) and all(h[x] == y for x, y in zip(words, w.hash(), strict=True))


def test_language_id(spark):
    alphabet = {"en": "the of and that with her was ing".split(), "de": "der und nicht ein mit schön für war".split()}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(alphabet[["en", "de"][i % 2]], 30)), ["en", "de"][i % 2], None, None, None) for i in range(200)]
    rows += [(200, None, "en", None, None, None), (201, "123 !?", None, None, None, None), (202, "тест" * 50, None, None, None, None), (None, "the of", None, None, None, None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 204
    assert all(out[i].lang_pred == ["en", "de"][i % 2] and not out[i].rejected for i in range(200))
    assert out[200].lang_pred == out[201].lang_pred == "und" and out[200].rejected and out[202].rejected
    assert all(0 <= r.score <= 1 for r in out.values()) and all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(203))
    assert language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs(spark).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    m = language_id.fit([("a", "abra cadabra abracadabra"), ("b", "banana bandana")] * 3)
    ctx = int(m.contexts[2][0])
    every = [int(x) for x in m.grams[0]] + [7]
    total = np.zeros(2)
    for w in every:
        key = np.array([ctx << 16 | w], np.uint64)
        k = [key & np.uint64((1 << 16 * n) - 1) for n in range(1, 5)]
        total += np.exp2(m._logp(k, 4)[0])
    assert total == pytest.approx([1, 1], abs=1e-4)


def test_language_scores_against_plain_kneser_ney():
    """Cross-entropies of the arrays against a recursion over dictionaries, symbol by symbol."""
    r = np.random.default_rng(5)
    said = {"a": ["abra cadabra, Abracadabra!", "a barber had a bar"], "b": ["banana bandana nab", "an anna and a nanna"], "c": ["x y z zyx yxz"]}
    m = language_id.fit([(k, t) for k, v in said.items() for t in v])
    texts = ["abra banana", "Zebra and x", "a", "été über", *["".join(r.choice(list("abcdnrxyz ,é"), 30)) for _ in range(20)]]
    letters = lambda t: [int(x) for x in language_id.symbols([t])[0]]
    grams = lambda s, n: [tuple(([0] * 3 + s)[i + 4 - n : i + 4]) for i in range(len(s))]
    vocabulary = len({x for v in said.values() for t in v for x in letters(t)}) + 1
    got = m.score(texts)[0]
    for j, lang in enumerate(m.langs):
        counts = {4: Counter(g for t in said[lang] for g in grams(letters(t), 4))}
        for n in (3, 2, 1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        off = {}
        for n, c in counts.items():
            n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
            off[n] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.5

        def p(g):
            n = len(g)
            c = counts[n]
            if n == 1:
                return max(c[g] - off[1], 0) / c.total() + off[1] * len(c) / c.total() / vocabulary
            same = [v for k, v in c.items() if k[:-1] == g[:-1]]
            low = p(g[1:])
            return max(c[g] - off[n], 0) / sum(same) + off[n] * len(same) / sum(same) * low if same else low

        for i, t in enumerate(texts):
            s = letters(t)
            assert got[i, j] == pytest.approx(-sum(np.log2(p(g)) for g in grams(s, 4)) / len(s), rel=1e-4)


def test_a_language_of_long_texts_is_learned(spark):
    """The bound of the sample is on characters, not on the length of a text."""
    long = lambda i, w: " ".join(np.random.default_rng(i).choice(w, 15_000))
    en, de = "the of and that with her was ing".split(), "der und nicht ein mit schön für war".split()
    rows = [(i, long(i, en), "en") for i in range(12)] + [(100 + i, long(i, de)[:300], "de") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(d).collect()} == {i: x for i, _, x in rows}
    assert {x for x, _ in language_id.sample(d, max_chars=1000)} == {"en", "de"} and sum(len(t) for x, t in language_id.sample(d, max_chars=1000) if x == "en") <= 2000
    nobody = d.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert language_id.accepted(nobody.unionByName(spark.createDataFrame([(1, "12", None), (2, None, None)], nobody.schema))).count() == len(rows)


def test_rule_ledger(spark):
    got = quality_rules.ledger(docs(spark)).collect()
    for r in got:
        if r.doc_id is None or r.doc_id == 3:
            continue
        t = TEXTS[r.doc_id] or ""
        w = t.encode().split()
        g = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i in range(len(w) - 2) if g[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
    a = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs(spark))).collect()}
    bits = [r.failed & quality_rules.mask_of("v1") for r in got]
    assert a["few_words"].n_failed == sum(b & 1 for b in bits) and a["few_words"].n_failed_alone == bits.count(1)
    assert quality_rules.ledger(empty(spark)).count() == 0


def wrapped(text, mark="", width=70):
    import textwrap

    return "\n".join(f"{mark}{x}".rstrip() for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""]))


def licence_text(*names):
    return "\n\n".join(licence_scan.SENTENCES[x] for x in names)


def test_licences(spark):
    S = licence_scan.SENTENCES
    mit = "Copyright (c) 2020 me\n\n" + licence_text("mit_permission", "mit_notice", "mit_as_is") + " IN NO EVENT SHALL THE AUTHORS BE LIABLE."
    bsd2 = "\n\n".join([S["bsd_redistribution"], "1. " + S["bsd_source"], "2. " + S["bsd_binary"]])
    clause = "3. Neither the name of Some University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd4 = f"{bsd2}\n\n3. {S['bsd_advertising']}\nThis product includes software developed by the University.\n\n{clause.replace('3.', '4.')}\n"
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    cases = [
        ("Hello.\nReleased under the MIT License.\nmore", {("MIT", "ref_MIT", 1)}),
        (f"head line\n{wrapped(mit)}\nend. Released under the MIT license!", {("MIT", "mit_text", 1)}),
        (wrapped(mit, "// "), {("MIT", "mit_text", 1)}), (wrapped(mit, " * ", 50), {("MIT", "mit_text", 1)}), (wrapped(mit, "# ") + "\n\nimport x\n" + wrapped(mit, "-- "), {("MIT", "mit_text", 2)}), (mit, {("MIT", "mit_text", 1)}),
        (wrapped(bsd2), {("BSD-2-Clause", "bsd2_text", 1)}), (wrapped(f"{bsd2}\n\n{clause}", "# "), {("BSD-3-Clause", "bsd3_text", 1)}), (wrapped(bsd4), {("BSD-4-Clause", "bsd4_text", 1)}),
        (wrapped(f"{bsd2}\n\n{clause}\n\n{bsd2}"), {("BSD-3-Clause", "bsd3_text", 1), ("BSD-2-Clause", "bsd2_text", 1)}), (wrapped(f"{S['bsd_redistribution']}\n\n{S['bsd_source']}"), {("BSD-1-Clause", "bsd1_text", 1)}),
        (wrapped(gpl2, "; "), {("GPL-2.0-or-later", "gpl2_header_old", 1)}), (wrapped(S["agpl3_header"], "% "), {("AGPL-3.0-or-later", "agpl3_header", 1)}), (wrapped(S["gpl2_only_kernel"], "/* "), {("GPL-2.0-only", "gpl2_only_kernel", 1)}),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright", {("GPL-3.0", "gpl3_text", 1)}),
        (wrapped('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may', "# ", 40), {("Apache-2.0", "apache2_header", 1)}),
        ("This project is licensed under the MIT License - see LICENSE.md.", {("MIT", "ref_MIT", 1)}), ("# The code is available under the terms of the\n# GNU Lesser General Public License, version 2.1", {("LGPL-2.1", "ref_LGPL-2.1", 1)}),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {("CC-BY-NC-SA-4.0", "ref_CC-BY-NC-SA-4.0", 1)}), ("shared under CC BY-SA 4.0. And Licensed under CC BY 4.0.", {("CC-BY-SA-4.0", "ref_CC-BY-SA-4.0", 1), ("CC-BY-4.0", "ref_CC-BY-4.0", 1)}),
        ("// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT) AND Zlib.\n/* spdx-license-identifier: Unlicense */", {("GPL-2.0-or-later", "spdx", 1), ("MIT", "spdx", 1), ("Zlib", "spdx", 1), ("Unlicense", "spdx", 1)}),
        ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: MIT and more", {("MIT", "spdx", 2)}), (wrapped(licence_text("isc_permission")), {("ISC", "isc_text", 1)}), (wrapped(licence_text("0bsd_permission")), {("0BSD", "0bsd_text", 1)}), (wrapped(licence_text("mit_0_permission", "mit_as_is")), {("MIT-0", "mit_0_text", 1)}),
        (wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", "// "), {("MPL-2.0", "mpl2_header", 1)}), (wrapped(licence_text("unlicense_free") + "\n\n" + licence_text("unlicense_anyone")), {("Unlicense", "unlicense_text", 1)}),
        (wrapped(licence_text("boost_permission")), {("BSL-1.0", "boost_text", 1)}), (wrapped(licence_text("zlib_as_is") + " " + licence_text("zlib_permission")), {("Zlib", "zlib_text", 1)}), ("x " * 2_000_000 + "\n" + wrapped(mit), {("MIT", "mit_text", 1)}),
        ("the MIT License", set()), (None, set()), ("", set()), (wrapped(S["mit_as_is"] + "\n\n" + S["mit_permission"]), set()), ("She was licensed under the old law. The model is provided by the school.", set()),
    ]
    d = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(cases)] + [(None, "Licensed under CC0.", 2, "y")] * 2, "doc_id long, text string, n_found int, spdx string")
    got = {}
    for r in licence_scan.scan(d).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.rule, r.n_found))
    assert sorted(got.pop(None)) == [("CC0-1.0", "ref_CC0-1.0", 1)] * 2
    assert {i: set(x) for i, x in got.items()} == {i: x for i, (_, x) in enumerate(cases) if x}
    assert licence_scan.scan(empty(spark)).count() == 0
    import re

    assert all(re.search(licence_scan.GATE, x) for x in licence_scan.known())


def test_licences_against_their_sql(spark):
    import duckdb

    S = licence_scan.SENTENCES
    rng = np.random.default_rng(2)
    bits = [*S.values(), "3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "plain words", "it is licensed under the MIT license", "SPDX-License-Identifier: MIT OR Apache-2.0", "Available under CC BY 4.0."]
    texts = [wrapped("\n\n".join(bits[i] for i in rng.integers(0, len(bits), 6)), ["", "# ", " * "][k % 3], 40 + k) for k in range(150)]
    texts += [wrapped("\n\n".join(S[x] for n in rng.permutation(len(licence_scan.RULES))[:3] for x in licence_scan.RULES[n][2] if x in S)) for _ in range(60)]
    rows = [*enumerate(texts), (500, None), (501, "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(licence_scan.oracle())
    got = licence_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 150


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_warc_round_trip(spark, tmp_path, broadcast_rows):
    fake = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 200
    html = [None, "", big, "x", big, big + fake + "tail" * 30 + fake, fake, f"{fake}{warc.MAGIC}", "x", "\r\n\r\n" * 40, warc.MAGIC * 20]
    rows = [(i, f"http://h/{i}\r\nX: y", h, 1) for i, h in enumerate(html)] + [(20, None, big, 1), (20, None, big, 1), (None, None, big, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, m int").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(warc.records(pages, broadcast_rows=broadcast_rows), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.digest_ok for r in got)
    for i, h in enumerate(html):
        b = (h or "").encode()
        (r,) = [r for r in got if r.page_id == i]
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        twin = first if len(b) >= 100 and first < i else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(b), hashlib.sha256(b).hexdigest(), twin, "response" if twin is None else "revisit")
    assert [r.refers_to for r in got if r.page_id in (20, None)] == [2, 2, 2]
    nothing = str(tmp_path / "none")
    warc.write_archives(warc.records(pages.where("false")), nothing)
    assert warc.read_archives(spark, nothing).count() == 0


def test_chain_over_blocks(spark, tmp_path):
    """Small reader splits: the chain crosses blocks, and payloads hold version lines."""
    rows = [(i, (warc.MAGIC + "x" * (i % 7)) * (i % 5) + "y" * 150 + str(i)) for i in range(300)]
    path = str(tmp_path / "w")
    warc.write_archives(warc.records(spark.createDataFrame(rows, "page_id long, html string").coalesce(1)), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 300 and all(got[i].payload_digest == hashlib.sha256(h.encode()).hexdigest() for i, h in rows)


QUOTES = [
    (1, 0, "user", "What is a join?\nPlease explain."), (1, 1, "assistant", "> What is a join?\nIt combines rows of tables."), (1, 2, "user", "On Monday A wrote:\n>> what is a JOIN?\n> It combines rows of tables.\n\nThanks!\nMy boss said:\nbuy it"),
    (1, 3, "user", "> unknown line here\nplain"), (2, 0, "user", ">It combines rows of tables!\nIs that so?"), (2, 1, "user", None), (2, 2, "user", ""), (None, 0, "user", "> What is a join?"), (3, None, "user", "x y"), (2, 1, "user", None),
    # wrapped anew, and cut within sentences
    (4, 0, "user", "The quick brown fox jumps over the lazy dog while seven other animals watch from the old wooden fence near the river and none of them says a word."),
    (4, 1, "assistant", "On Tue, 3 May 2022 at 10:00, Some Body <s@b.org>\nwrote:\n> The quick brown fox jumps over the lazy dog\n> while seven other animals watch from the old\n> wooden fence near the river and none of them\n> says a word.\n\nNice fox."),
    (4, 2, "user", ">> seven other animals watch from the old wooden fence near the river and none\n> Nice fox.\nIndeed nice."),
    (4, 3, "user", "> The quick brown fox jumps over the lazy dog while\n> seven other animals watch\nI like the dog."), (4, 4, "assistant", "> Indeed nice.\nWhy?"), (4, 5, "user", "> I like the dog.\n> Nice fox.\nok"), (4, 5, "user", "> I like the dog.\n> Nice fox.\nok"),
    (5, 0, "user", "a said:\n\n\n> none\nb\x03c\r\nd"), (5, 1, "user", "long " * 40000 + "\n> b c"),
]


def test_quotation_links(spark):
    m = spark.createDataFrame([(*r, 1, 0) for r in QUOTES], "conv_id long, turn long, role string, text string, depth int, root_turn int")
    out = chat_quotes.threads(m).collect()
    got = {(r.conv_id, r.turn): r for r in out}
    assert len(out) == len(QUOTES)
    link = {k: (r.parent_conv, r.parent_turn, r.depth) for k, r in got.items() if r.parent_conv}
    assert link == {(1, 1): (1, 0, 1), (1, 2): (1, 1, 2), (2, 0): (1, 1, 2), (4, 1): (4, 0, 1), (4, 2): (4, 1, 2), (4, 3): (4, 0, 1), (4, 4): (4, 2, 3), (4, 5): (4, 3, 2), (5, 1): (5, 0, 1)}
    assert got[1, 2].text == "Thanks!\nMy boss said:\nbuy it" and got[1, 2].n_quoted == 2 and got[1, 2].n_linked == 2 and got[4, 1].text == "Nice fox." and got[5, 0].text == "b c\nd"
    assert (got[2, 0].root_conv, got[2, 0].root_turn) == (1, 0) and got[4, 5].n_quoted == 1
    order = lambda c: [k for k, _ in sorted(((k, (r.root_turn, r.reply_order)) for k, r in got.items() if r.root_conv == c and k[1] is not None), key=lambda x: x[1])]
    assert order(4) == [(4, 0), (4, 1), (4, 2), (4, 4), (4, 3), (4, 5)] and order(1) == [(1, 0), (1, 1), (2, 0), (1, 2), (1, 3)]
    c = chat_quotes.conversations(m).where("root_conv = 4").collect()
    assert [r.turn for r in c] == [0, 1, 2, 4, 3, 5, 5]
    assert chat_quotes.threads(m.where("false")).count() == 0


def test_quotation_query_looks_up_every_run(spark, tmp_path):
    """A quote cut within a sentence, none of whose runs is in the quarter that the SQL looks up; and one that both link, to the same message."""
    chosen = lambda w: hashlib.md5(" ".join(w).encode()).hexdigest()[0] < "4"
    words = [f"v{i}" for i in range(200)]
    a = next(i for i in range(1, 190) if not any(chosen(words[i + j : i + j + 5]) for j in range(3)))
    b = next(i for i in range(1, 190) if chosen(words[i : i + 5]))
    rows = [(1, 0, "u", " ".join(words)), (1, 1, "u", "> " + " ".join(words[a : a + 7]) + "\nyes"), (1, 2, "u", "> " + " ".join(words[b : b + 5]) + "\nno")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    m.write.parquet(str(tmp_path / "conversations.parquet"))
    linked = lambda d: {r.turn: (r.parent_turn, r.n_linked) for r in d.collect()}
    assert linked(chat_quotes.link(chat_quotes.parse(m))) == {1: (None, 0), 2: (0, 1)}
    assert linked(chat_quotes.query(spark, str(tmp_path))) == {0: (None, 0), 1: (0, 1), 2: (0, 1)}


def test_quotation_links_against_their_sql(spark):
    import duckdb

    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, said = list(QUOTES), {}
    for conv in range(100, 130):
        for turn in range(12):
            text = ". ".join(" ".join(r.choice(vocabulary, r.integers(2, 15))) for _ in range(r.integers(1, 4))) + "."
            quote = []
            for _ in range(r.integers(0, 3)):
                if said and r.random() < 0.8:
                    words = said[list(said)[r.integers(max(0, len(said) - 30), len(said))]].split(" ")
                    a, b = sorted(r.integers(0, len(words) + 1, 2))
                    part = " ".join(words[a:b]) if r.random() < 0.4 else " ".join(words)
                    quote += [f"{'>' * r.integers(1, 3)} {x}" for x in wrapped(part, width=int(r.integers(20, 90))).split("\n")]
            rows.append((conv, turn, "u", "\n".join([*quote, wrapped(text, width=50)])))
            said[conv, turn] = text
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.sql(chat_quotes.ORACLE)
    got = [tuple(x) for x in chat_quotes.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*want.columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and sum(x[4] is not None for x in got) > 100
