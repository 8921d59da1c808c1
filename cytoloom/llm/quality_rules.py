"""Operator 6. Quality rules: rule bitmask ledger.

Each text is measured once; the ledger has its measurements and one failure bit for each rule, and `stored` writes it to the shared folder.
Policies are versioned masks over those bits, so a policy is applied, or a rule left out, without reading texts again. `ablations` adds up bit patterns.

Null and empty texts have no words and fail the base rule. An empty table gives no rows; repeated rows are judged alike, and a null doc_id stays
null. Texts of any length are measured whole. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ByteWords, blocks, materialise, table, text_bytes

_MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
WHITESPACE = b" \t\n\x0b\x0c\r"

#: Name, bit and failing condition of each rule. Bits are never reused: a changed rule gets a new one.
RULES: list[tuple[str, int, str]] = [
    ("few_words", 0, "n_words < 50"),
    ("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    ("symbols", 2, "10 * n_symbols > n_words"),
    ("duplicate_lines", 3, "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", 4, "word_chars > 12 * n_words"),
    ("short_words", 5, "word_chars < 2 * n_words"),
    ("many_words", 6, "n_words > 100000"),
]
#: Version: the rules that count.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words"],
    "v1_sized": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words", "many_words"],
}
CURRENT = "v1"


def mask_of(version: str) -> int:
    bit = {name: b for name, b, _ in RULES}
    return reduce(operator.or_, (1 << bit[n] for n in POLICIES[version]), 0)


def repeat_words(words: ByteWords, n_docs: int) -> np.ndarray:
    """For each text, words in 3-word windows that occur twice or more in it."""
    n = len(words.start)
    if n < 3:
        return np.zeros(n_docs, np.int64)
    h = words.hash()
    k, doc = np.uint64(0x9E3779B97F4A7C15), words.doc
    same = doc[2:] == doc[:-2]
    g = (h[:-2] * k + h[1:-1]) * k + h[2:]
    at = np.flatnonzero(same)
    g = (g[at] ^ (g[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + doc[at].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(g)
    s = g[order]
    eq = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    cover = np.zeros(n, bool)
    p = at[order[twice]]
    cover[p] = cover[p + 1] = cover[p + 2] = True
    return np.bincount(doc[cover], minlength=n_docs)


def measure(docs: DataFrame) -> DataFrame:
    """The measurements of every whole text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            texts = text_bytes(b.column(1))
            n = len(texts)
            w = ByteWords(texts)
            n_words = np.bincount(w.doc, minlength=n)
            chars, symbols, lines, dups = (np.zeros(n, np.int64) for _ in range(4))
            for i, t in enumerate(texts):
                solid = t.translate(None, WHITESPACE)
                chars[i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
                symbols[i] = len(solid) - len(solid.translate(None, SYMBOLS))
                seen = Counter(x for x in t.split(b"\n") if x.strip(WHITESPACE))
                lines[i], dups[i] = seen.total(), seen.total() - len(seen)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, lines, dups, repeat_words(w, n)))], [f.split()[0] for f in _MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed`, the bit set of the rules that a text breaks."""
    bits = reduce(operator.add, (F.when(F.expr(cond), F.lit(1 << b)).otherwise(F.lit(0)) for _, b, cond in RULES))
    return measure(docs).withColumn("failed", bits.cast("long"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written and read again: what policies and ablations are computed from."""
    return materialise(ledger(docs), "ledger")


def passes(version: str = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask_of(version))) == 0


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone (what leaving the rule out would let in), and kept by the policy. One row a bit pattern is shuffled."""
    mask = mask_of(version)
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << b).cast("long").alias("bit")) for name, b, _ in RULES if mask >> b & 1])
    x = patterns.withColumn("r", F.explode(names))
    return x.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(F.col("p").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("p") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("n_kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ~passes("base")
    return stored(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes().alias("kept"), "n_lines", "failed")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tg AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS g FROM tri),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tg) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON cov.doc_id IS NOT DISTINCT FROM w.doc_id),
f AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
      + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars > 12 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT
      + 64 * (n_words > 100000)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 63) = 0 AS kept,
       n_lines, failed FROM f
"""
