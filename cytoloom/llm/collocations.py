"""Operator 12. Phrase collocation mining by suffix-sigma.

Each task cuts texts into pieces and words and counts, block by block, the suffixes that start at each word, truncated to max_n words. They are
shuffled by language and first word; where that is a hot prefix (more than one occurrence in SHARE), by language and two words, and so on. Tasks
sort them in reverse lexicographic order. A stack of the open prefixes, one a length, then counts all prefixes in one pass: rows that share a
prefix follow each other, and a prefix is done when a row without it comes. Hot prefixes, which several tasks count in part, are added up
afterwards. Candidates then look up the counts of their parts by joins, and the lowest-scoring cut counts.

Words are [^ \\t]+ between [.,;:!?\\n-\\r], A-Z lower-cased. A null language is `und`; null and empty texts have no words; repeated rows count as
often as they occur; ties of score and count go to the lesser phrase in byte order, ties of cuts to the shorter first part. An empty table gives
no rows. Texts of any length are taken whole. No columns but lang and text are read, so others change nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import blocks, materialise, mix, table, trim

MAX_N, MIN_COUNT, COVERED, TOP = 3, 10, 50, 2000
#: Bytes of text whose suffixes a worker counts at once.
BLOCK = 4 << 20
#: Rows that the stack takes on together.
ROWS = 1 << 16
#: A prefix is hot if more than one occurrence in so many has it, so that each length has fewer hot prefixes than this; blocks report those with a fifth of that share.
SHARE = 1000
#: Parts of a partition that keys are dealt to.
DEALT = 64
#: A language's report is sorted in one task after so many parts of it have been cut to its length.
SALTS = 64

_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BREAKS)] = 2
_KIND[list(_BLANKS)] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Ends a language and each word of a key. No text has the first, no word the second, so the keys that start with a prefix lie together in byte order.
END_LANG, END_WORD = b"\xff", b" "


class Words:
    """The words of a block of texts: sorted distinct words, languages, and for each occurrence its language and the codes of the words from there on (the last code of all: none)."""

    def __init__(self, texts: list[bytes], langs: pa.Array, max_n: int):
        buf = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], kind > 0])))
        start, end = edge[0::2], edge[1::2]
        offset = np.concatenate([[0], np.cumsum(end - start)])
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(buf[kind == 0].tobytes())]).dictionary_encode()
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.none = found.dictionary.take(pa.array(order)), len(order)
        code = rank[found.indices.to_numpy(zero_copy_only=False)]
        piece = np.cumsum(kind == 2)[start]
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
        names = langs.dictionary_encode()
        self.langs = [x.encode() for x in names.dictionary.to_pylist()]
        self.lang = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        self.level = [code]
        for i in range(1, max_n):
            after = np.full(len(code), self.none)
            if i < len(code):
                after[:-i] = np.where(piece[i:] == piece[:-i], code[i:], self.none)
            self.level.append(after)

    def distinct(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One occurrence of each distinct (language, next `size` words) and their numbers, in order of the words."""
        key, span = self.lang, max(1, len(self.langs))
        for x in self.level[:size]:
            if span * (self.none + 1) >= 1 << 62:
                seen, key = np.unique(key, return_inverse=True)
                span = len(seen)
            key, span = key * (self.none + 1) + x, span * (self.none + 1)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        return first, n

    def keys(self, at: np.ndarray, size: int) -> pa.Array:
        """Language and `size` words of occurrences as bytes, each with its end."""
        langs = pa.array([x + END_LANG for x in self.langs], pa.large_binary())
        spelled = pc.binary_join_element_wise(self.words, pa.scalar(b"", pa.large_binary()), pa.scalar(END_WORD, pa.large_binary()))
        spelled = pa.concat_arrays([spelled, pa.array([b""], pa.large_binary())])
        return pc.binary_join_element_wise(langs.take(pa.array(self.lang[at])), *(spelled.take(pa.array(x[at])) for x in self.level[:size]), pa.scalar(b"", pa.large_binary()))


def _blocks(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[Words]:
    for b in blocks(batches, 1, BLOCK):
        yield Words([x or b"" for x in b.column(1).to_pylist()], b.column(0), max_n)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def hot_prefixes(docs: DataFrame, max_n: int = MAX_N) -> set[bytes]:
    """Keys of prefixes, shorter than max_n, that more than one word's occurrence in SHARE starts with: fewer than SHARE for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches, max_n):
            total = len(w.lang)
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([total], pa.int64())], ["key", "n"])
            for size in range(1, max_n):
                first, n = w.distinct(size)
                first, n = first[n * 5 * SHARE > total], n[n * 5 * SHARE > total]
                yield pa.RecordBatch.from_arrays([w.keys(first, size).cast(pa.binary()), pa.array(n.astype(np.int64))], ["key", "n"])

    # a key with fewer words than its size ends a piece: it is a whole suffix, which no further word could split
    counts = materialise(_texts(docs).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")), "prefixes")
    total = counts.where(F.octet_length("key") == 0).agg(F.sum("n")).first()[0] or 0
    return {bytes(r.key) for r in counts.where((F.octet_length("key") > 0) & (F.col("n") * SHARE > total)).select("key").collect()}


def _dealt(w: Words, at: np.ndarray, hot: set[bytes], parts: int) -> np.ndarray:
    """Where suffixes go: a hash of the language and first word, and of a further word as long as what is before it is a hot prefix."""
    crc = np.append(np.fromiter((zlib.crc32(x) for x in w.words.to_pylist()), np.uint64, w.none), np.uint64(0))
    place = {x: i for i, x in enumerate(w.words.to_pylist())} if hot else {}
    langs = {x: i for i, x in enumerate(w.langs)}
    h = np.array([zlib.crc32(x) for x in w.langs], np.uint64)[w.lang[at]]
    prefix, span, go = w.lang[at], max(1, len(w.langs)), np.ones(len(at), bool)
    for size, level in enumerate(w.level, 1):
        x = level[at]
        h[go] = mix(h[go] * np.uint64(31) + crc[x[go]])
        if size == len(w.level) or span > (1 << 62) // (w.none + 1):
            break
        prefix, span = prefix * (w.none + 1) + x, span * (w.none + 1)
        here = []
        for key in hot:
            lang, _, text = key.partition(END_LANG)
            words = text.split(END_WORD)[:-1]
            if len(words) == size and lang in langs and all(y in place for y in words):
                k = langs[lang]
                for y in words:
                    k = k * (w.none + 1) + place[y]
                here.append(k)
        go = go & np.isin(prefix, here)
    return (h % np.uint64(parts)).astype(np.int32)


def suffixes(docs: DataFrame, hot: set[bytes], parts: int, max_n: int = MAX_N) -> DataFrame:
    """(dealt, key, n): truncated suffixes with their counts by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _blocks(batches, max_n):
            first, n = w.distinct(max_n)
            yield pa.RecordBatch.from_arrays([pa.array(_dealt(w, first, hot, parts)), w.keys(first, max_n).cast(pa.binary()), pa.array(n.astype(np.int32))], ["dealt", "key", "n"])

    return _texts(docs).mapInArrow(run, "dealt int, key binary, n int")


class Stack:
    """Open prefixes of sorted keys, one for each number of words (0: the language alone), with their counts so far. Takes a batch's rows on together."""

    def __init__(self, max_n: int, least: int, hot: set[bytes]):
        self.max_n, self.least, self.hot = max_n, least, hot
        self.hot_sizes = {k.count(END_WORD) for k in hot}
        self.last: bytes | None = None
        self.open: list[tuple[bytes, int] | None] = [None] * (max_n + 1)

    def push(self, data: np.ndarray, offset: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Prefixes that end in these rows, and their counts. Row i's key is data[offset[i]:offset[i + 1]]."""
        done: list[tuple[bytes, int]] = []
        start, size = offset[:-1], np.diff(offset)
        ends = np.flatnonzero((data == END_LANG[0]) | (data == END_WORD[0])) + 1
        bound = np.searchsorted(ends, offset, "right")
        own, count = bound[:-1], np.diff(bound)
        same = _common(data, start, size)  # bytes that a row shares with the one before
        same[0] = self._shared(data[: size[0]].tobytes())
        for i in range(self.max_n + 1):
            has = np.flatnonzero(count > i)
            if len(has):
                length = ends[own[has] + i] - start[has]
                # a row without such a prefix stands between rows of unlike ones only
                new = np.flatnonzero(same[has] < length)
                old, rows = self.open[i], n[has]
                if old is not None:
                    old = self.open[i] = (old[0], old[1] + int(rows[: new[0] if len(new) else len(rows)].sum()))
                if len(new):
                    if old is not None:
                        done.append(old)
                    sums = np.add.reduceat(rows, new)
                    at = start[has[new]]
                    to = at + length[new]
                    key = lambda k: data[at[k] : to[k]].tobytes()  # noqa: B023, E731
                    fine = sums[:-1] >= (self.least if i else 0)
                    done += [(key(k), int(sums[k])) for k in np.flatnonzero(fine)]
                    if i in self.hot_sizes:  # hot prefixes may be rare here
                        done += [(x, int(sums[k])) for k in np.flatnonzero(~fine) if (x := key(k)) in self.hot]
                    self.open[i] = (key(len(new) - 1), int(sums[-1]))
        self.last = data[start[-1] : offset[-1]].tobytes()
        return self._out(done)

    def _shared(self, key: bytes) -> int:
        """Bytes that a key shares with the last one pushed."""
        if self.last is None:
            return 0
        return next((i for i, (a, b) in enumerate(zip(self.last, key)) if a != b), min(len(self.last), len(key)))

    def _out(self, done: list[tuple[bytes, int]]) -> tuple[list[bytes], list[int]]:
        done = [(k, n) for k, n in done if n >= self.least or k.endswith(END_LANG) or k in self.hot]
        return [k for k, _ in done], [n for _, n in done]

    def finish(self) -> tuple[list[bytes], list[int]]:
        done = [x for x in self.open if x is not None]
        self.open = [None] * (self.max_n + 1)
        return self._out(done)


def _common(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before; 0 for the first. Eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = np.zeros(len(start), np.int64)
    most = np.minimum(size[1:], size[:-1])
    at, k = np.arange(1, len(start)), 0
    while len(at):
        unlike = eight[start[at] + k] ^ eight[start[at - 1] + k]
        low = unlike & (~unlike + np.uint64(1))  # the lowest bit that differs
        out[at] = np.where(unlike == 0, k + 8, k + (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        at = at[(unlike == 0) & (most[at - 1] > k + 8)]
        k += 8
    out[1:] = np.minimum(out[1:], most)
    return out


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the keys in a row, their offsets, and the counts."""
    keys = pa.concat_arrays([b.column(0).cast(pa.large_binary()) for b in batches])
    offset = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    data = np.frombuffer(keys.buffers()[2], np.uint8)[offset[0] : offset[-1]]
    return data, offset - offset[0], np.concatenate([b.column(1).to_numpy() for b in batches]).astype(np.int64)


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, size, f): phrases of up to max_n words that occur at least `least` times, and for each language the number of all words (empty phrase, size 0)."""
    spark = docs.sparkSession
    hot = hot_prefixes(docs, max_n)
    parts = DEALT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes(docs, hot, parts, max_n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least, hot)
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.binary()), pa.array(x[1], pa.int64())], ["key", "f"])
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= ROWS:
                yield out(stack.push(*_columns(held)))
                held = []
        if sum(x.num_rows for x in held):
            yield out(stack.push(*_columns(held)))
        yield out(stack.finish())
        trim()

    counted = rows.repartition("dealt").select("key", "n").sortWithinPartitions(F.col("key").desc()).mapInArrow(run, "key binary, f long")
    whole = counted.groupBy("key").agg(F.sum("f").alias("f"))
    # the language ends at the only byte that no text has
    at = F.locate("FF", F.regexp_replace(F.hex("key"), "(..)", "$1 ")).alias("at")
    named = whole.select("key", "f", ((at - 1) / 3).cast("int").alias("len"))
    phrase = F.rtrim(F.expr("CAST(substring(key, len + 2) AS STRING)"), F.lit(" "))
    out = named.select(F.expr("CAST(substring(key, 1, len) AS STRING)").alias("lang"), phrase.alias("phrase"), "f")
    out = out.withColumn("size", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))))
    return materialise(out.where((F.col("size") == 0) | (F.col("f") >= least)).select("lang", "phrase", "size", "f"), "phrases")


def _cut(lo, n):
    """Words lo+1 to lo+n of the candidate."""
    return F.concat_ws(" ", F.slice("ws", lo + 1, n))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all candidates: phrases of two words and more, by their lowest-scoring cut."""
    cand = counts.where("size >= 2").withColumn("ws", F.split("phrase", " "))
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "size", F.col("f").alias("a"), "k", _cut(F.lit(0), F.col("k")).alias("head"), _cut(F.col("k"), F.col("size") - F.col("k")).alias("tail"))
    part = counts.where("size >= 1")
    left = part.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    big = "decimal(16,0)"
    both = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).withColumn("up", F.col("a").cast(big) * F.col("a").cast(big) * F.lit(1000000).cast("decimal(7,0)")).withColumn("down", F.col("l").cast(big) * F.col("r").cast(big))
    low = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(F.expr("up div down").alias("score"), "k", "l", "r")).alias("x"))
    return low.select("lang", "phrase", "size", "a", "x.l", "x.r", "x.score")


def covered(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer candidate that holds the phrase's words contiguously."""
    size = F.col("size")
    places = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(0), size - m), lambda lo: F.concat_ws(" ", F.slice("ws", lo + 1, m)))))
    longer = counts.where("size >= 3").withColumn("ws", F.split("phrase", " "))
    return longer.select("lang", F.explode(F.array_distinct(places)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT, cover: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and spelling.

    Candidates occur `least` times; a candidate goes if a longer one that holds it occurs `cover` % as often.
    """
    counts = phrase_counts(docs, max_n, least)
    best = scored(counts).join(covered(counts), ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < cover * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS))).withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH word AS MATERIALIZED (
    SELECT lang, p, i, list_extract(ws, i) AS w, ws FROM (
        SELECT lang, p, ws, unnest(range(1, len(ws) + 1)) AS i FROM (
            SELECT lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (
                SELECT lang, row_number() OVER () AS p, piece FROM (
                    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents))))
), f AS MATERIALIZED (
    SELECT lang, phrase, size, count(*) AS f FROM (
        SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM word, (SELECT unnest(range(1, {MAX_N} + 1)) AS size) WHERE i + size - 1 <= len(ws))
    GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), cuts AS (
    SELECT *, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2
), scores AS (
    SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), low AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
    SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = low.lang AND g.size = 3 AND 100 * g.f >= {COVERED} * low.a AND low.phrase <> g.phrase
        AND (array_to_string(string_split(g.phrase, ' ')[1:2], ' ') = low.phrase OR array_to_string(string_split(g.phrase, ' ')[2:3], ' ') = low.phrase))
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN (SELECT lang, count(*) AS n FROM word GROUP BY lang) USING (lang)
WHERE rank <= {TOP}
"""
