"""Operator 5. Language ID: interpolated Kneser-Ney character models.

One model a language, of order 4 over letters and single blanks, estimated on a bounded sample of labelled documents: for each language, in an
order drawn by hash, up to MAX_DOCS documents until they hold MAX_CHARS characters (a longer one gives its first MAX_CHARS to the fit). All languages share sorted arrays of n-gram keys; beside each key stand
the languages' interpolated log probabilities (and, for contexts, back-off weights), so one binary search a character and order serves all
languages. The language of the least cross-entropy a character wins. Calibration documents, kept out of the estimates, give each language's
own entropy and that of its text under the nearest other language. A document is rejected if its best entropy lies nearer to the latter,
by more than its length explains: no model knows it better than a foreign text.

Null text, or text without letters: `und`, score 0, rejected. With no labelled text at all every document is `und`; `accepted` then keeps every
text with letters, since nothing is known that could reject it. An empty table gives no rows. Repeated rows are judged alike; ties go to the
first language in alphabetical order. Texts of any length are judged whole. A null doc_id is kept, and counts as empty text for the fold. More
than MAX_LANGS labels are an error. Extra columns, whatever their names, are left out by `identify` and kept by `accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import blocks, crc32_mod5, table

ORDER = 4
#: Bounds of the labelled sample: documents and characters of each language, and languages.
MAX_DOCS, MAX_CHARS, MAX_LANGS = 400, 2_000_000, 1000
#: Share of sample documents that calibrate the rejection, and how many standard deviations a clean document may lie out.
CALIBRATION, WIDTH = 0.25, 6.0
_OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double, n_letters long"

_FOLD: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code point to 16-bit symbol: lower-case letter, or 0 for what isn't a letter."""
    global _FOLD
    if _FOLD is None:
        t = np.zeros(0x110000, np.uint16)
        for c in [*range(0xD800), *range(0xE000, 0x10000)]:
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
        for c in range(0x10000, 0x110000):
            if chr(c).isalpha():
                t[c] = 0xFFFF
        _FOLD = t
    return _FOLD


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, one blank between runs of letters and around each text; the text of each symbol; letters of each text."""
    joined = "\x00".join([*texts, ""])  # every text ends in a separator, the last one too
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    s = fold()[cp]
    doc = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    letters = np.bincount(doc[s != 0], minlength=len(texts))
    keep = s != 0
    keep[1:] |= keep[:-1]  # the first blank after a word
    return s[keep], doc[keep], letters


def keys(s: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """keys[n-1]: the n-gram that ends at each symbol, as a 16-bit-a-symbol number; blanks stand before a text's start."""
    out = [s.astype(np.uint64)]
    for n in range(1, ORDER):
        back = np.zeros(len(s), np.uint64)
        if len(s) > n:
            back[n:] = np.where(doc[n:] == doc[:-n], s[:-n], 0)
        out.append(out[-1] | back << np.uint64(16 * n))
    return out


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # by order, sorted keys
    logp: list[np.ndarray]  # by order: (keys, languages) log2 of the interpolated probability
    contexts: list[np.ndarray]  # by context length from 1, sorted keys
    weight: list[np.ndarray]  # by context length: log2 of the back-off weight
    unknown: np.ndarray  # log2 probability of a symbol never seen, by language
    mean: np.ndarray
    spread: np.ndarray
    slack: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol for each text and language; letters and symbols of each text."""
        s, doc, letters = symbols(texts)
        n = np.bincount(doc, minlength=len(texts))
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, (1 << 23) // max(1, len(self.langs)))
        every = keys(s, doc)
        for a in range(0, len(s), step):
            lp = self._logp([k[a : a + step] for k in every], ORDER)
            d = doc[a : a + step]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            total[d[first]] += np.add.reduceat(lp, first, axis=0)
        return -total / np.maximum(n, 1)[:, None], letters, n

    def _logp(self, k: list[np.ndarray], order: int) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.unknown, (len(k[0]), len(self.langs)))
        g, at = self.grams[order - 1], None
        at = np.minimum(np.searchsorted(g, k[order - 1]), len(g) - 1)
        hit = g[at] == k[order - 1]
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            low = self._logp([x[miss] for x in k[: max(1, order - 1)]], order - 1)
            if order > 1:
                c, ck = self.contexts[order - 2], k[order - 1][miss] >> np.uint64(16)
                i = np.minimum(np.searchsorted(c, ck), len(c) - 1)
                low = low + np.where((c[i] == ck)[:, None], self.weight[order - 2][i], 0)
            out[miss] = low
        return out


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of a bounded sample outside the held-out fold. A hash of the id thins each language to about twice the bound before rows are ranked."""
    d = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc32_mod5() != 0) & F.col("text").rlike(r"\p{L}"))
    n = {r[0]: r[1] for r in d.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if not n:
        return []
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, 2.0 * max_docs / c + 100 / c))])[F.col("lang")]
    few = d.withColumn("draw", draw).where(F.col("draw") < share).withColumn("text", F.substring("text", 1, max_chars))
    w = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    few = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_docs)
    few = few.withColumn("before", F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("r")) - F.length("text")).where(F.col("before") < max_chars)
    return sorted((r[0], r[1]) for r in few.select("lang", "text").collect())


def _rows(gram: np.ndarray, table_keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(table_keys, gram)


def fit(labelled: list[tuple[str, str]]) -> Model | None:
    """Kneser-Ney estimates: raw counts at the highest order, continuation counts below, one absolute discount an order from its counts of counts."""
    langs = sorted({x for x, _ in labelled})
    if not langs:
        return None
    fits, checks = {}, {}
    for lang in langs:
        texts = [t for x, t in labelled if x == lang]
        cut = int(len(texts) * CALIBRATION) if len(texts) >= 8 else 0
        checks[lang], fits[lang] = texts[:cut] or texts, texts[cut:]
    counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang in langs:
        s, doc, _ = symbols(fits[lang])
        top = np.unique(keys(s, doc)[ORDER - 1], return_counts=True)
        per = [top]
        for n in range(ORDER - 1, 0, -1):  # kinds of symbols before each n-gram
            suffix = per[0][0] & np.uint64((1 << 16 * n) - 1)
            per.insert(0, np.unique(suffix, return_counts=True))
        counts[lang] = per
    grams = [np.unique(np.concatenate([counts[x][n][0] for x in langs])) for n in range(ORDER)]
    contexts = [np.unique(g >> np.uint64(16)) for g in grams[1:]]
    vocabulary = len(grams[0]) + 1
    logp = [np.zeros((len(g), len(langs)), np.float32) for g in grams]
    weight = [np.zeros((len(c), len(langs)), np.float32) for c in contexts]
    unknown = np.zeros(len(langs), np.float32)
    for j, lang in enumerate(langs):
        below = None
        for n in range(ORDER):
            g, c = counts[lang][n]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 and n2 else 0.5
            if n == 0:
                lam = d * len(c) / c.sum()
                p = np.full(len(grams[0]), lam / vocabulary)
                p[_rows(g, grams[0])] += (c - d) / c.sum()
                unknown[j] = np.log2(lam / vocabulary)
            else:
                ctx = g >> np.uint64(16)
                u, first = np.unique(ctx, return_index=True)
                totals, kinds = np.add.reduceat(c, first), np.diff(np.append(first, len(g)))
                lam = np.ones(len(contexts[n - 1]))
                lam[_rows(u, contexts[n - 1])] = d * kinds / totals
                weight[n - 1][:, j] = np.log2(lam)
                low_key = grams[n] & np.uint64((1 << 16 * n) - 1)
                p = below[_rows(low_key, grams[n - 1])] * lam[_rows(grams[n] >> np.uint64(16), contexts[n - 1])]
                p[_rows(g, grams[n])] += (c - d) / totals[np.searchsorted(u, ctx)]
            logp[n][:, j] = np.log2(p)
            below = p
    zero = np.zeros(len(langs))
    m = Model(langs, grams, logp, contexts, weight, unknown, zero, zero.copy(), zero.copy())
    for j, lang in enumerate(langs):
        x, _, n = m.score(checks[lang])
        h = x[:, j]
        m.mean[j] = np.average(h, weights=n)
        m.spread[j] = np.sqrt(np.mean((h - m.mean[j]) ** 2 * n)) + 1e-6
        others = np.delete(x, j, axis=1)
        foreign = np.average(others.min(axis=1), weights=n) if others.shape[1] else 2 * m.mean[j] + 2
        m.slack[j] = max(0.0, (foreign - m.mean[j]) / 2)
    return m


def judge(m: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, rejected, cross-entropy and letters of each text."""
    n = len(texts)
    if m is None:
        return ["und"] * n, np.zeros(n), np.ones(n, bool), np.full(n, np.nan), np.zeros(n, np.int64)
    h, letters, size = m.score(texts)
    j = h.argmin(axis=1)
    best, ok = h[np.arange(n), j], letters > 0
    odds = np.exp2(-(h - best[:, None]) * np.minimum(size, 8)[:, None])
    rejected = best > m.mean[j] + m.slack[j] + WIDTH * m.spread[j] / np.sqrt(np.maximum(size, 1))
    return [m.langs[i] if y else "und" for i, y in zip(j, ok, strict=True)], np.where(ok, 1 / odds.sum(axis=1), 0.0), np.where(ok, rejected, True), best, letters


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Language, score (0 to 1: how far the winner's probability a symbol stands above the others'), and whether the text is rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in blocks(batches):
            texts = [x or "" for x in b.column(1).to_pylist()]
            lang, score, rejected, best, letters = judge(m, texts)
            ok = letters > 0 if m is not None else np.zeros(len(texts), bool)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(np.where(ok, best, np.nan), mask=~ok), pa.array(letters.astype(np.int64))],
                [f.split()[0] for f in _OUT.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc32_mod5() == 0).alias("held_out")).mapInArrow(run, _OUT)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(sample(docs)))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected. No join: rows are judged as they pass."""
    model = fit(sample(docs))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in blocks(batches, at):
            yield b.filter(pa.array(~judge(m, [x or "" for x in b.column(at).to_pylist()])[2]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
