"""Operator 2. Benchmark decontamination by latent semantic retrieval.

1. Texts become term numbers of the benchmark's vocabulary (0 for other words) in the shared folder; passage frequencies over all documents give
the inverse passage frequency of each term. 2. Randomised SVD: every passage's TF-IDF row x adds x (x Omega) to a sketch of fixed size; its
Nystrom factors are the latent basis. Terms outside the vocabulary meet no item and have no weight. 3. Windows of each item's length
are projected and compared with the item by cosine, but for those that hold too few of the item's words to pass the next step. 4. Candidates are
confirmed by the longest common subsequence of words, of the item or of its segments one by one (so that parts in another order count), and by the
answer check: the terms that stand in the matched stretch must carry a share of the item's weight, so what is asked and answered is there and
not its function words alone. Items of fewer than MIN_WORDS words have no subsequence to speak of: they are found word for word, those of
one or two words only as a whole document.

The benchmark is worked through in blocks of at most BLOCK_WORDS words, so what is broadcast is bounded. Null and empty texts hold nothing;
items of null text or without words are found nowhere. Repeated rows are each reported, rows with a null doc_id too; an empty table on either side
gives no rows. A text that repeats an item is reported once for it, at its best window, the first of equals. Texts of any length are searched
whole. Extra columns, whatever their names, are left out by `leaks` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ByteWords, blocks, materialise, table, text_bytes

MIN_WORDS, BLOCK_WORDS = 5, 500_000
#: Words in a passage of the TF-IDF matrix; rank of the latent space; columns of the sketch beyond it; seed of the sketch.
PASSAGE, RANK, OVERSAMPLE, SEED = 32, 32, 8, 7
#: Least cosine, least subsequence (as a share of the item) and least share of its weight among the terms of the matched stretch.
COSINE, SUBSEQUENCE, ANSWER = 0.5, 0.45, 0.45
#: Words of a segment at least, segments at most, and least sum of their subsequences (as a share of the item) and cosine where the item's own falls short.
SEGMENT, SEGMENTS, IN_PARTS, PARTS_COSINE = 5, 4, 0.6, 0.6

_MARKS = bytes(c if chr(c) not in ".,;:!?\"()[]{}<>*_" else 32 for c in range(256))
_TERMS = "doc_id long, terms binary"
_HITS = "doc_id long, item_id long, cosine double, lcs long, item_words long, answer double, at long"


def words_of(texts: list[bytes]) -> ByteWords:
    return ByteWords([(t if t.isascii() else t.decode("utf-8", "replace").lower().encode()).translate(_MARKS) for t in texts], lower=True)


class Benchmark:
    """Items as term numbers, short ones apart, and the vocabulary: sorted word hashes; term number = place + 1."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        w = words_of([t for _, t in rows])
        h = w.hash()
        size = np.bincount(w.doc, minlength=len(rows))
        self.vocabulary = np.unique(h)
        edge = np.searchsorted(w.doc, np.arange(len(rows) + 1))
        every = [(rows[i][0], self.number(h[edge[i] : edge[i + 1]])) for i in np.flatnonzero(size)]
        self.items = [x for x in every if len(x[1]) >= MIN_WORDS]
        self.short = [x for x in every if len(x[1]) < MIN_WORDS]

    def number(self, h: np.ndarray) -> np.ndarray:
        v = self.vocabulary
        if not len(v):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(v, h), len(v) - 1)
        return np.where(v[at] == h, at + 1, 0)


def numbered(docs: DataFrame, bench) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bench.value
        kind = "<u2" if len(b.vocabulary) < 65535 else "<u4"
        for x in blocks(batches):
            w = words_of(text_bytes(x.column(1)))
            t = b.number(w.hash()).astype(kind)
            edge = np.searchsorted(w.doc, np.arange(x.num_rows + 1))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([t[p:q].tobytes() for p, q in zip(edge, edge[1:], strict=False)], pa.binary())], ["doc_id", "terms"])

    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TERMS), "terms")


def _read(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids, concatenated term numbers, and ends of the documents."""
    kind = "<u4" if wide else "<u2"
    for b in blocks(batches):
        parts = b.column(1).to_pylist()
        yield b.column(0), np.frombuffer(b"".join(parts), kind).astype(np.int64), np.cumsum([len(x) // (4 if wide else 2) for x in parts])


def _passages(t: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of each term's passage."""
    start = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(np.concatenate([[0], ends])))
    cut = (np.arange(len(t)) - start) % PASSAGE == 0
    return np.cumsum(cut) - 1


def weights(terms: DataFrame, n_terms: int, wide: bool) -> np.ndarray:
    """Inverse passage frequencies; words outside the vocabulary (place 0) weigh nothing, terms that no passage holds as much as the rarest that one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_terms + 1, np.int64), 0
        for _, t, ends in _read(batches, wide):
            if len(t):
                p = _passages(t, ends)
                n += int(p[-1]) + 1
                first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                row = np.zeros((len(first), PASSAGE), np.uint32 if wide else np.uint16)  # a passage's terms side by side, to be sorted and told apart
                row[p, np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))] = t
                row.sort(axis=1)
                new = np.concatenate([row[:, :1], row[:, 1:] * (row[:, 1:] != row[:, :-1])], axis=1)
                df += np.bincount(new.ravel(), minlength=n_terms + 1)
        df[0] = n  # place 0 carries the number of passages
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    got = {r[0]: r[1] for r in terms.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    n = max(got.get(0, 1), 1)
    df = np.array([got.get(i, 0) for i in range(n_terms + 1)], float)
    df[0] = 0
    idf = np.log((1 + n) / (1 + df)) + 0.1
    idf[0] = 0
    idf[1:][df[1:] == 0] = idf.max(where=df > 0, initial=0.1)
    return idf


def basis(terms: DataFrame, idf: np.ndarray, wide: bool, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x rank) and singular values of the TF-IDF passage matrix over all documents."""
    v, keep, rank = len(idf), rank, rank + OVERSAMPLE
    omega = np.random.default_rng(SEED).standard_normal((v, rank)).astype(np.float32)
    omega[0] = 0
    shared = terms.sparkSession.sparkContext.broadcast((idf.astype(np.float32), omega * idf[:, None].astype(np.float32)))
    slices = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, om = shared.value
        y = np.zeros((v, rank))
        for _, t, ends in _read(batches, wide):
            p = _passages(t, ends)
            known = np.flatnonzero(t)
            for at in range(0, len(known), 1 << 18):  # passages cut at a block's edge are two shorter rows
                k = known[at : at + (1 << 18)]
                tk, pk = t[k], p[k]
                first = np.flatnonzero(np.concatenate([[True], pk[1:] != pk[:-1]]))
                row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pk))))
                z = np.add.reduceat(om[tk], first, axis=0)
                o = np.argsort(tk if wide else tk.astype(np.uint16), kind="stable")  # numbers of 16 bits are sorted by their digits
                s = tk[o]
                cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                y[s[cut]] += np.add.reduceat(z[row[o]], cut, axis=0) * w[s[cut], None]
        parts = np.array_split(y.astype(np.float64), slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "y"])

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in it:
            for s, raw in zip(pdf["slice"], pdf["y"], strict=True):
                total[s] = total.get(s, 0) + np.frombuffer(raw, np.float64)
        yield pd.DataFrame({"slice": pd.Series(list(total), dtype="int32"), "y": [x.tobytes() for x in total.values()]})

    got = sorted(terms.mapInArrow(run, "slice int, y binary").repartition(slices, "slice").mapInPandas(add, "slice int, y binary").collect())
    y = np.concatenate([np.frombuffer(r[1], np.float64) for r in got]).reshape(v, rank) if got else np.zeros((v, rank))
    # Nystrom: A'A is about Y (Omega' Y)^-1 Y'
    core = omega.T.astype(float) @ y
    core = (core + core.T) / 2
    val, vec = np.linalg.eigh(core)
    ok = val > max(val.max(initial=0), 0) * 1e-10
    if not ok.any():
        return np.zeros((v, 0), np.float32), np.zeros(0)
    u, s, _ = np.linalg.svd(y @ (vec[:, ok] / np.sqrt(val[ok])), full_matrices=False)
    return u[:, :keep].astype(np.float32), s[:keep]


def lcs(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Length of the longest common subsequence of words (bit-parallel), and the first and last matched places of the text."""
    where: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v, best, lo, hi = full, 0, -1, 0
    for j, x in enumerate(text.tolist()):
        m = where.get(x, 0) if x else 0
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            n = len(item) - v.bit_count()
            if n > best:
                best, hi = n, j + 1
                lo = j if lo < 0 else lo
    return best, max(lo, 0), hi


def in_parts(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """As lcs, summed over segments of the item, wherever each stands."""
    n = min(SEGMENTS, len(item) // SEGMENT)
    got = [lcs(x, text) for x in np.array_split(item, n)] if n > 1 else [(0, 0, 0)]
    return sum(g[0] for g in got), min(g[1] for g in got), max(g[2] for g in got)


class Flags:
    """Counts of flagged places up to any place: a byte each, eight at a time."""

    _below = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)

    def __init__(self, flags: np.ndarray):
        self.words = np.append(flags, np.zeros(16 - len(flags) % 8, np.uint8)).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def at_most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A bound from above on the flags in [8a, 8b)."""
        return self.before[b] - self.before[a]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        up_to = lambda x: self.before[x >> 3] + np.bitwise_count(self.words[x >> 3] & self._below[x & 7])
        return up_to(b) - up_to(a)


def _common(numbers: np.ndarray, a: np.ndarray, b: np.ndarray, count: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches [a, b) of numbers of an item's terms (0 for other words): words in common with the item, each as often as in both, and the weight of the item's words that stand there. Both bound what a subsequence or the answer check can reach."""
    overlap, share = np.empty(len(a), np.int64), np.empty(len(a))
    for i in range(0, len(a), 4096):
        k = b[i : i + 4096] - a[i : i + 4096]
        first = np.cumsum(k) - k
        key = np.repeat(np.arange(len(k)) * (len(count) + 1), k) + numbers[np.arange(k.sum()) + np.repeat(a[i : i + 4096] - first, k)]
        n = np.bincount(key, minlength=len(k) * (len(count) + 1)).reshape(len(k), -1)[:, 1:]
        overlap[i : i + 4096], share[i : i + 4096] = np.minimum(n, count).sum(axis=1), (n > 0) @ weight
    return overlap, share


def word_for_word(item: np.ndarray, t: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """(document, first place) of a short item in concatenated texts; one or two words must be all of a text."""
    n = len(item)
    at = np.flatnonzero(t[: max(0, len(t) - n + 1)] == item[0])
    for i in range(1, n):
        at = at[t[at + i] == item[i]]
    d = np.searchsorted(ends, at, "right")
    ok = at + n <= ends[d]
    if n < 3:
        ok &= ends[d] - starts[d] == n
    d, at = d[ok], at[ok]
    new = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
    return list(zip(d[new].tolist(), (at[new] - starts[d[new]]).tolist(), strict=True))


def search(terms: DataFrame, bench, idf: np.ndarray, q: np.ndarray, wide: bool) -> DataFrame:
    by_class: dict[int, list[int]] = {}
    for i, (_, t) in enumerate(bench.value.items):
        size = 8
        while size < len(t):
            size = -(-size * 5 // 4)
        by_class.setdefault(size, []).append(i)
    latent = q * idf[:, None].astype(np.float32)
    z = np.stack([latent[t].sum(axis=0) for _, t in bench.value.items]) if bench.value.items else np.zeros((0, q.shape[1]))
    z = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    rare = [(*(u := np.unique(t, return_counts=True)), idf[u[0]] / idf[u[0]].sum()) for _, t in bench.value.items]
    # what each class asks of a stretch at least: words of its items, and the most that each term can add to an item's share
    least = {}
    for size, members in by_class.items():
        share = np.zeros(len(idf))
        for i in members:
            np.maximum.at(share, rare[i][0], rare[i][2])
        least[size] = (SUBSEQUENCE * min(len(bench.value.items[i][1]) for i in members), share)
    shared = terms.sparkSession.sparkContext.broadcast((latent, z, rare, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latent, z, rare, least = shared.value
        items = bench.value.items
        for ids, t, ends in _read(batches, wide):
            n = len(t)
            if not n:
                continue
            starts = np.concatenate([[0], ends[:-1]])
            begin = np.repeat(starts, ends - starts)
            end = np.repeat(ends, ends - starts)
            terms_at = t[t > 0]
            number = np.zeros(len(latent), np.uint8 if max((len(x[0]) for x in rare), default=0) < 256 else np.int32)
            n_known = np.concatenate([[0], np.cumsum(t > 0)])
            best: dict[tuple[int, int], tuple] = {}
            for size, members in by_class.items():
                step = max(1, size // 6)
                many = -(-(ends - starts) // step)
                at = np.arange(many.sum()) * step + np.repeat(starts - (np.cumsum(many) - many) * step, many)
                to = np.minimum(at + size, end[at])
                lo, hi = np.maximum(begin[at], at - size // 4), np.minimum(end[at], to + size // 4)
                n_words, share = least[size]
                value = share.take(t, mode="clip")
                held = np.concatenate([[0], np.cumsum(value > 0, dtype=np.int32)])
                part = np.concatenate([[0], np.cumsum(value)])
                ok = (held[hi] - held[lo] >= n_words) & (part[hi] - part[lo] >= ANSWER - 1e-6) & (to - at >= size // 2)
                at, to, lo, hi = at[ok], to[ok], lo[ok], hi[ok]
                ka, kb = n_known[lo], n_known[hi]
                ca, cb = ka >> 3, (kb + 7) >> 3
                for idx in members if len(at) else ():
                    # the item's words in reach of a window bound the subsequence and the answer's share: drop what can't reach both
                    item, (uniq, count, weight) = items[idx][1], rare[idx]
                    number[uniq] = np.arange(1, len(uniq) + 1)
                    numbers = number.take(terms_at, mode="clip")
                    number[uniq] = 0
                    own = Flags((numbers > 0).view(np.uint8))
                    rows = np.flatnonzero(own.at_most(ca, cb) >= SUBSEQUENCE * len(item))
                    rows = rows[own.between(ka[rows], kb[rows]) >= SUBSEQUENCE * len(item)]
                    if not len(rows):
                        continue
                    overlap, share = _common(numbers, ka[rows], kb[rows], count, weight)
                    ok = (overlap >= SUBSEQUENCE * len(item)) & (share >= ANSWER - 1e-6)
                    rows, overlap = rows[ok], overlap[ok]
                    if not len(rows):
                        continue
                    cos = np.zeros(len(rows), np.float32)
                    for a in range(0, len(rows), 1 << 12):
                        wa, wb = at[rows[a : a + (1 << 12)]], to[rows[a : a + (1 << 12)]]
                        k = wb - wa
                        first = np.cumsum(k) - k
                        x = np.add.reduceat(latent[t[np.repeat(wa - first, k) + np.arange(k.sum())]], first, axis=0)
                        cos[a : a + (1 << 12)] = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)) @ z[idx]
                    for c in np.argsort(-cos, kind="stable"):
                        if cos[c] < COSINE:
                            break
                        row = rows[c]
                        d = int(np.searchsorted(ends, at[row], "right"))
                        if best.get((d, idx), (0,))[0] >= len(item):
                            continue
                        text = t[lo[row] : hi[row]]
                        for alike, share, nearest in ((lcs, SUBSEQUENCE, COSINE), (in_parts, IN_PARTS, PARTS_COSINE)):
                            if cos[c] < nearest or overlap[c] < share * len(item):
                                break
                            length, p, q2 = alike(item, text)
                            if length < share * len(item):
                                continue
                            answer = float(weight[np.isin(uniq, text[p:q2])].sum())
                            if answer >= ANSWER:
                                if length > best.get((d, idx), (0,))[0]:
                                    best[d, idx] = (length, float(cos[c]), answer, int(lo[row]) + p - int(starts[d]))
                                break
            out = [(ids[d].as_py(), items[i][0], cos, n_lcs, len(items[i][1]), ans, at) for (d, i), (n_lcs, cos, ans, at) in sorted(best.items())]
            out += [(ids[d].as_py(), i, 1.0, len(item), len(item), 1.0, at) for i, item in bench.value.short for d, at in word_for_word(item, t, starts, ends)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], [f.split()[0] for f in _HITS.split(", ")])

    return terms.mapInArrow(run, _HITS)


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, item_words, answer, at): documents that hold a benchmark item, with the word at which the match starts."""
    spark = docs.sparkSession
    b = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = b.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // block_words))
    out = None
    for i in range(n):
        rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        bench = Benchmark([(r[0], r[1].encode()) for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))])
        if not len(bench.vocabulary):
            continue
        shared, v = spark.sparkContext.broadcast(bench), len(bench.vocabulary)
        wide = v >= 65535
        terms = numbered(docs, shared)
        idf = weights(terms, v, wide)
        q, _ = basis(terms, idf, wide)
        hits = search(terms, shared, idf, q, wide)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else spark.createDataFrame([], _HITS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item. Rows of one id go together, as do rows with a null id and the same text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("null id"), F.col("text").cast("string")))
    has_id = F.col("doc_id").isNotNull()
    with_ids, without = docs.where(has_id), docs.where(~has_id).withColumn("_text_key", key)
    held = leaks(with_ids, benchmark).select("doc_id").distinct()
    kept = with_ids.join(held, "doc_id", "left_anti").select(*docs.columns)
    if without.isEmpty():
        return kept
    also = leaks(without.withColumn("doc_id", F.col("_text_key")).select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("_text_key")).distinct()
    return kept.unionByName(without.join(also, "_text_key", "left_anti").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
