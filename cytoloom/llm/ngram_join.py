"""Operator 9. N-gram Jaccard join by grouped prefixes.

Sets are the distinct shingles of `size` words of a text. Two texts link when 100 * intersection >= threshold * union (SHINGLE and THRESHOLD
unless a caller says otherwise).

1. Equal sets are one node. Shingles are ordered rarest first by a count sketch of fixed size over all documents (an order need only be the
same everywhere, so counts may be rough), and nodes with the same prefix and size form one group. 2. Groups that share a prefix shingle are
candidates: all pairs of a short list; of a long one, neighbours by size and a common leader, whose verified links span most of a cluster.
3. Pairs pass the size and the parity-bitmap filter (both exact bounds), groups expand to members, members' sets are compared.
4. Lists are gone through again for pairs whose ends are still in different components; these are all checked, so no link between two components
is lost. 5. Links exist within components alone: each component's sets are ordered by size and cut into tiles of bounded size, and tiles whose
sizes can link are compared in place, set by set. Only counts (or, for `links`, the links themselves) leave a tile.

Null text, or text without words, is an empty set and links with nothing. Texts with fewer words than a shingle are one shingle. Rows with
a null doc_id take part but give no component id, so their component is that of the least id that they reach, or null. Repeated rows
share a component and link with each other. An empty table gives no rows. Shingles are compared by 64-bit hashes of their words, never by frequency or
bitmap alone: among two sets of 10^5 shingles a chance agreement has odds of some 10^-9. Texts of any length are taken whole. Extra columns, whatever
their names, are left out by `cluster` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import ByteWords, blocks, materialise, mix, small_batches, table, text_bytes, trim

SHINGLE, THRESHOLD = 4, 85
#: Counters of the frequency sketch (a power of two), slices it is added up in, bits of a node's parity bitmap, bits of the filter of needed nodes.
COUNTERS, SLICES, BITMAP, NEEDED_BITS = 1 << 22, 64, 1024, 1 << 26
#: Lists up to this length give all pairs at once.
SHORT = 4
#: Salts of the leaders that the entries of a longer list are first compared with; largest side of a tile in the second comparison; shingles on a side of a tile in the count of links.
LEADERS, TILE, TILE_SHINGLES = (0, 12345, 67890, 424242), 1000, 200_000
#: Entries that a task gathers before it goes through their lists; hashes gathered before they are counted.
ENTRIES, HASHES = 1 << 19, 1 << 21


def band_of(threshold: int) -> int:
    """Size codes (2000 times the logarithm of the size) of linked sets differ by no more, rounding included."""
    return int(2000 * np.log(100 / threshold)) + 2


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, ordered by both; and each document's set size."""
    w = ByteWords(texts, lower=True)
    h = w.hash()
    k = np.uint64(0x9E3779B97F4A7C15)
    n_words = np.bincount(w.doc, minlength=len(texts))
    g, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= size:
        m = len(h) - size + 1
        g = h[:m].copy()
        for i in range(1, size):
            g = g * k + h[i : i + m]
        ok = w.doc[size - 1 :] == w.doc[:m]
        g, d = mix(g[ok]), w.doc[:m][ok]
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(few):
        at = np.searchsorted(w.doc, few)
        short = []
        for i, n in zip(at, n_words[few], strict=True):
            x = 0
            for y in h[i : i + n].tolist():
                x = (x * int(k) + y + 1) & ((1 << 64) - 1)
            short.append(x ^ int(n))
        g, d = np.concatenate([g, mix(np.array(short, np.uint64))]), np.concatenate([d, few])
    o = np.lexsort((g, d))
    g, d = g[o], d[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return d, g, np.bincount(d, minlength=len(texts))


def _sums(d: np.ndarray, x: np.ndarray, n_docs: int) -> np.ndarray:
    """Sum modulo 2^64 of x over each document."""
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=s[1:])
    edge = np.searchsorted(d, np.arange(n_docs + 1))
    return s[edge[1:]] - s[edge[:-1]]


def set_keys(d: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(_sums(d, mix(g + np.uint64(5)), len(n)) + n.astype(np.uint64))


def frequency_classes(texts: DataFrame, counters: int = COUNTERS, *, size: int = SHINGLE) -> np.ndarray:
    """Class of each sketch counter: 0 for what chance explains, else the logarithm of the excess. Of fixed size, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held, n = np.zeros(counters, np.uint32), [np.zeros(0, np.int64)], 0

        def count() -> None:
            np.add(c, np.bincount(np.concatenate(held), minlength=counters), out=c, casting="unsafe")

        for b in blocks(batches):
            held.append((shingle_sets(text_bytes(b.column(1)), size)[1] >> np.uint64(20)).astype(np.int64) & (counters - 1))
            n += len(held[-1])
            if n >= HASHES:
                count()
                held, n = [np.zeros(0, np.int64)], 0
        count()
        z = zstandard.ZstdCompressor(level=1)
        cut = np.array_split(c, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([z.compress(x.tobytes()) for x in cut], pa.binary())], ["slice", "counts"])

    def add(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in it:
            for s, raw in zip(pdf["slice"], pdf["counts"], strict=True):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.uint64)
                total[s] = total[s] + x if s in total else x
        yield pd.DataFrame({"slice": pd.Series(list(total), dtype="int32"), "counts": [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in total.values()]})

    got = texts.mapInArrow(run, "slice int, counts binary").repartition(SLICES, "slice").mapInPandas(add, "slice int, counts binary").collect()
    c = np.zeros(counters)
    if got:
        c = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r[1]), np.uint64) for r in sorted(got)]).astype(float)
    mean = c.mean()
    return np.minimum(np.log2(1 + np.maximum(0, c - mean - 4 * np.sqrt(mean))), 255).astype(np.uint8)


class Prefixes:
    """Prefix shingles of each document's set, rarest first, and its group: prefix and size."""

    def __init__(self, d: np.ndarray, g: np.ndarray, n: np.ndarray, classes: np.ndarray, threshold: int = THRESHOLD):
        rank = classes[(g >> np.uint64(20)).astype(np.int64) & (len(classes) - 1)].astype(np.uint64) << np.uint64(56) | g >> np.uint64(8)
        o = np.lexsort((rank, d))
        rank = rank[o]
        place = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
        inside = place < (n - -(-threshold * n // 100) + 1)[d]
        self.doc, self.token = d[inside], rank[inside]
        key = mix(_sums(self.doc, mix(self.token + np.uint64(9)), len(n)) + n.astype(np.uint64))
        size = np.minimum(np.log(np.maximum(n, 1)) * 2000, 65535).astype(np.uint64)
        self.group = (size << np.uint64(47) | key >> np.uint64(17)).astype(np.int64)  # groups sort by size


def bitmaps(d: np.ndarray, g: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity of the elements that share a hash's low bits: two sets differ in at least as many elements as their bitmaps in bits. Of BITMAP bits, or the power of two above twice the set's size."""
    bit = np.bincount(d * BITMAP + (g & np.uint64(BITMAP - 1)).astype(np.int64), minlength=len(n) * BITMAP)[: len(n) * BITMAP] & 1
    out = [x.tobytes() for x in np.packbits(bit.astype(np.uint8).reshape(len(n), BITMAP), axis=1)]
    for i in np.flatnonzero(2 * n > BITMAP):
        size = 1 << int(2 * n[i] - 1).bit_length()
        a, b = np.searchsorted(d, [i, i + 1])
        out[i] = np.packbits((np.bincount((g[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()
    return out


def _matrix(bits: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of one length as 64-bit words, folded to `size` bytes (halves of a parity bitmap add up by xor)."""
    m = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    while m.shape[1] > size:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return np.ascontiguousarray(m).view(np.uint64)


def _lengths(bits: list[bytes]) -> dict[int, np.ndarray]:
    n = np.fromiter(map(len, bits), np.int64, len(bits))
    return {int(x): np.flatnonzero(n == x) for x in np.unique(n)}


def _apart(a: int, b: int, threshold: int) -> bool:
    """Whether sets whose bitmaps have these lengths are too unlike in size to link: lengths are powers of two, so they may differ up to twice as much as the sizes."""
    return threshold * max(a, b) >= 200 * min(a, b)


_DOCS = "doc_id long, mark long, n long, node long, grp long, bits binary, tokens binary"


def measured(texts: DataFrame, classes, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Set size, node, group, parity bitmap and prefix of each document; mark is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            d, g, n = shingle_sets(text_bytes(b.column(1)), size)
            p = Prefixes(d, g, n, classes.value, threshold)
            edge = np.searchsorted(p.doc, np.arange(len(n) + 1))
            tokens = [np.sort(p.token[x:y]).tobytes() for x, y in zip(edge, edge[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(set_keys(d, g, n).view(np.int64)), pa.array(p.group), pa.array(bitmaps(d, g, n), pa.binary()), pa.array(tokens, pa.binary())], [f.split()[0] for f in _DOCS.split(", ")])

    return texts.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, _DOCS)


def postings(nodes: DataFrame) -> DataFrame:
    """(token, grp): prefix shingles of the groups, once for each lot of rows that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            t = np.frombuffer(b"".join(raw), np.int64)
            grp = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in raw])
            o = np.lexsort((grp, t))
            t, grp = t[o], grp[o]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (grp[1:] != grp[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(t[new]), pa.array(grp[new])], ["token", "grp"])

    return nodes.select("grp", "tokens").mapInArrow(run, "token long, grp long")


def _lists(threshold: int = THRESHOLD, entries: int = ENTRIES):
    """Goes through entries in the order of (token, group). Gives candidate pairs (kind 0: a, b are groups) and the entries of long lists (kind 1: a is the list, b a group). A list that goes on where a lot ends counts as long; it keeps its number."""
    reach = band_of(threshold)

    def step(t: np.ndarray, g: np.ndarray, before: tuple[int, int, int] | None, more: bool) -> tuple[pa.RecordBatch, tuple[int, int, int]]:
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
        t, g = t[new], g[new]
        # a list ends where the next size is too far to link; each such run is a list of its own
        code = g >> 47
        start = np.ones(len(t), bool)
        start[1:] = (t[1:] != t[:-1]) | (code[1:] - code[:-1] > reach)
        first = np.flatnonzero(start)
        number = mix(t[first].view(np.uint64) ^ mix(g[first].view(np.uint64)))
        size = np.diff(np.append(first, len(t)))
        long_run = size > SHORT
        if before is not None and before[0] == t[0] and code[0] - before[1] <= reach:
            number[0], long_run[0] = before[2], True
        after = (int(t[-1]), int(code[-1]), int(number[-1]))
        if more:
            long_run[-1] = True
        is_long, t = np.repeat(long_run, size), np.repeat(number, size)
        a, b = [], []
        for gap in range(1, SHORT):
            at = np.flatnonzero((t[gap:] == t[:-gap]) & ~is_long[gap:] & (code[gap:] - code[:-gap] <= reach))
            a.append(g[at])
            b.append(g[at + gap])
        long = np.flatnonzero(is_long)
        if len(long):
            lt, lg = t[long], g[long]
            band = mix(lt + (lg >> 47).astype(np.uint64) // np.uint64(reach))  # leaders by size
            for salt in LEADERS:  # the same leaders wherever they occur
                order = np.lexsort((mix(lg.astype(np.uint64) + np.uint64(salt)), band))
                lead_at = np.flatnonzero(np.concatenate([[True], band[order][1:] != band[order][:-1]]))
                lead = np.empty(len(lg), np.int64)
                lead[order] = np.repeat(lg[order][lead_at], np.diff(np.append(lead_at, len(lt))))
                a.append(np.minimum(lead, lg)[lead != lg])
                b.append(np.maximum(lead, lg)[lead != lg])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        kind = np.concatenate([np.zeros(pairs.shape[1], np.int32), np.ones(len(long), np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([pairs[0], t[long].view(np.int64)])), pa.array(np.concatenate([pairs[1], g[long]]))], ["kind", "a", "b"]), after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, before = [], 0, None

        def lot(end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, before
            t, g = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
            cut = len(t) if end else int(np.searchsorted(t, t[-1]))
            whole = cut > 0  # else one list fills the lot: it is gone through in parts
            cut = cut or len(t)
            out, before = step(t[:cut], g[:cut], before, more=not whole)
            held, n = [pa.RecordBatch.from_arrays([pa.array(t[cut:]), pa.array(g[cut:])], ["token", "grp"])], len(t) - cut
            yield out

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= entries:
                yield from lot(False)
        if n:
            yield from lot(True)

    return run


def _plausible(pairs: DataFrame, nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, gap): pairs of nodes that the size and bitmap bounds leave; gap is the bitmaps' distance as a share of the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = b.column(4).to_pylist(), b.column(5).to_pylist()
            far = np.empty(b.num_rows, np.int64)
            ly = _lengths(y)
            for u, i in _lengths(x).items():
                for v, j in ly.items():
                    k = np.intersect1d(i, j, assume_unique=True)
                    if len(k):
                        far[k] = np.bitwise_count(_matrix([x[r] for r in k], min(u, v)) ^ _matrix([y[r] for r in k], min(u, v))).sum(axis=1)
            most = (100 - threshold) * (na + nb) // (100 + threshold)
            ok = (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (far <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok)), pa.array(far[ok] / (most[ok] + 1.0))], ["a", "b", "gap"])

    one = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits{s}"))
    near = (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return pairs.join(one("a"), "a").join(one("b"), "b").where(near).select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long, gap double")


def _tiles(mixed: DataFrame, nodes: DataFrame, nearest: bool, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): pairs in one list, of different components, that the bounds leave. Lists are cut into tiles, whose pairs are compared in place; only what the bounds leave is a row (with nearest, only the nearest for each entry outside the list's main component)."""
    m = mixed.join(nodes.select("node", F.col("n").alias("size"), "bits"), "node")
    place = lambda c: F.pmod(F.xxhash64("node"), F.ceil(F.col(c) / TILE)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(c) / TILE) - 1).cast("int")))
    cols = ["token", "i", "j", "side", "node", "comp", "size", "bits"]
    left = m.where("comp <> main").withColumn("i", place("n_other")).withColumn("j", every("n_all")).withColumn("side", F.lit(0))
    right = m.withColumn("j", place("n_all")).withColumn("i", every("n_other")).withColumn("side", F.lit(1))

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        k = int((x["side"].to_numpy() == 0).sum())
        node, comp, size = (x[c].to_numpy() for c in ("node", "comp", "size"))
        bits = x["bits"].tolist()
        a, b = [], []
        right = _lengths(bits[k:])
        for lu, iu in _lengths(bits[:k]).items():
            for lv, iv in right.items():
                if _apart(lu, lv, threshold):
                    continue
                iv = iv + k
                bu, bv = (_matrix([bits[r] for r in i], min(lu, lv)) for i in (iu, iv))
                step = max(1, (1 << 20) // max(1, len(iv) * bv.shape[1]))
                for at in range(0, len(iu), step):
                    i = iu[at : at + step]
                    u, v = size[i, None], size[None, iv]
                    ok = (comp[i, None] != comp[None, iv]) & (100 * np.minimum(u, v) >= threshold * np.maximum(u, v))
                    p, q = np.nonzero(ok)
                    far = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bu[at + p[z : z + 4096]] ^ bv[q[z : z + 4096]]).sum(axis=1) for z in range(0, len(p), 4096))])
                    keep = far <= (100 - threshold) * (size[i[p]] + size[iv[q]]) // (100 + threshold)
                    p, q, far = p[keep], q[keep], far[keep]
                    if nearest and len(p):
                        o = np.lexsort((far, p))
                        o = o[np.concatenate([[True], p[o][1:] != p[o][:-1]])]
                        p, q = p[o], q[o]
                    a.append(node[i[p]])
                    b.append(node[iv[q]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}) if a else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in it:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf[["token", "i", "j"]].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            cuts = [0, *edge.tolist()]
            done = [compare(pdf.iloc[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            held = pdf.iloc[cuts[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True).drop_duplicates()
        if held is not None and len(held):
            yield compare(held)

    both = left.select(cols).unionByName(right.select(cols))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j", "side").mapInPandas(run, "a long, b long")


def _elements(texts: DataFrame, nodes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, elements as sorted 64-bit hashes) of the nodes given, from their least documents. A bit filter of fixed size keeps most other documents from being read twice; what passes by chance joins nothing."""
    word = 1 << 16
    bit = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(-1))), F.lit(NEEDED_BITS))

    def gather(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for s, x in pdf.groupby(pdf["bit"] // word):
                m = np.zeros(word, np.uint8)
                m[x["bit"].to_numpy() % word] = 1
                yield pd.DataFrame({"s": [int(s)], "m": [zstandard.ZstdCompressor().compress(np.packbits(m).tobytes())]})

    need = np.zeros((NEEDED_BITS // word, word // 8), np.uint8)
    for s, m in nodes.select(bit("rep").alias("bit")).repartition(16, F.floor(F.col("bit") / word)).sortWithinPartitions("bit").mapInPandas(gather, "s long, m binary").collect():
        need[s] |= np.frombuffer(zstandard.ZstdDecompressor().decompress(m), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor().compress(need.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for b in blocks(batches):
            at = b.column(0).to_numpy()
            b = b.filter(pa.array((flag[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            d, g, n = shingle_sets(text_bytes(b.column(1)), size)
            edge = np.searchsorted(d, np.arange(len(n) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(d, g, n).view(np.int64)), pa.array([g[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)], pa.binary())], ["node", "elements"])

    return texts.select(bit("doc_id").alias("bit"), "text").mapInArrow(run, "node long, elements binary")


def _verified(pairs: DataFrame, elements: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): pairs whose sets meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum())
                ok[i] = 100 * both >= threshold * (len(u) + len(v) - both)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    one = lambda s: elements.select(F.col("node").alias(s), F.col("elements").alias(f"e{s}"))
    return pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with edges. Each round hooks nodes to their least neighbour, jumps pointers to the roots and contracts the edges; rounds and jumps are few because both halve what is left."""
    total, e = None, materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        m = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        m = materialise(m, "hooks")
        while True:
            up = m.toDF("p", "q")
            j = materialise(m.join(up, "p", "left").select("node", F.coalesce("q", "p").alias("q"), "p"), "jumps")
            still = j.where("q <> p").isEmpty()
            m = j.select("node", F.col("q").alias("p"))
            if still:
                break
        total = m if total is None else materialise(total.join(m.toDF("p", "q"), "p", "left").select("node", F.coalesce("q", "p").alias("p")), "labels")
        left = e.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        e = materialise(left, "edges")
        if e.isEmpty():
            return total.toDF("node", "comp")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each of x with each of y, all sorted."""
    if len(x) * len(y) <= 64:
        return np.array([[int((u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v).sum()) for v in y] for u in x], np.int64).reshape(len(x), len(y))
    u, v = np.concatenate(x), np.concatenate(y)
    both = np.intersect1d(u, v)
    ru, rv = np.repeat(np.arange(len(x)), list(map(len, x))), np.repeat(np.arange(len(y)), list(map(len, y)))
    pu, pv = np.searchsorted(both, u), np.searchsorted(both, v)
    ok = np.append(both, 0)[pu] == u
    ru, pu = ru[ok], pu[ok]
    ok = np.append(both, 0)[pv] == v
    rv, pv = rv[ok], pv[ok]
    ou, ov = np.argsort(pu, kind="stable"), np.argsort(pv, kind="stable")
    ru, pu, rv, pv = ru[ou], pu[ou], rv[ov], pv[ov]
    out, step = np.zeros((len(x), len(y)), np.float32), 4096
    for a in range(0, len(both), step):  # products of 0/1 matrices, some columns at a time
        i, j = np.searchsorted(pu, [a, a + step]), np.searchsorted(pv, [a, a + step])
        m, k = np.zeros((len(x), step), np.float32), np.zeros((len(y), step), np.float32)
        m[ru[i[0] : i[1]], pu[i[0] : i[1]] - a] = 1
        k[rv[j[0] : j[1]], pv[j[0] : j[1]] - a] = 1
        out += m @ k.T
    return out.astype(np.int64)


def _component_links(members: DataFrame, threshold: int, pairs: bool) -> DataFrame:
    """Of (comp, node, n, copies, elements): (node, far), the rows whose sets link with a node's; or, with pairs, (a, b), each link between two sets once."""
    w = Window.partitionBy("comp").orderBy("n", "node")
    m = members.withColumn("tile", F.floor((F.sum("n").over(w) - 1) / TILE_SHINGLES).cast("int"))
    m = materialise(m, "members")
    t = m.groupBy("comp", "tile").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("k"))
    j = t.select("comp", F.col("tile").alias("j"), F.col("least").alias("least_j"), F.col("k").alias("kj"))
    tiles = t.select("comp", F.col("tile").alias("i"), "most", "k").join(j, "comp").where((F.col("i") < F.col("j")) | ((F.col("i") == F.col("j")) & (F.col("k") > 1))).where(100 * F.col("most") >= threshold * F.col("least_j")).select("comp", "i", "j")
    tiles = materialise(tiles, "tiles")
    left = m.withColumnRenamed("tile", "i").join(tiles, ["comp", "i"]).withColumn("side", F.lit(0))
    right = m.withColumnRenamed("tile", "j").join(tiles.where("i < j"), ["comp", "j"]).withColumn("side", F.lit(1))
    cols = ["comp", "i", "j", "side", "node", "n", "copies", "elements"]

    def compare(x: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node, n, copies = (x.column(c).to_numpy() for c in ("side", "node", "n", "copies"))
        sets = [np.frombuffer(e, np.uint64) for e in x.column("elements").to_pylist()]
        one = side.max() == 0
        a = np.flatnonzero(side == 0)
        b = a if one else np.flatnonzero(side == 1)
        both = _intersections([sets[r] for r in a], [sets[r] for r in b])
        ok = 100 * both >= threshold * (n[a][:, None] + n[b][None, :] - both)
        if one:
            np.fill_diagonal(ok, False)
        if pairs:
            p, q = np.nonzero(np.triu(ok) if one else ok)
            u, v = node[a[p]], node[b[q]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])
        else:
            far = [(a, (ok * copies[b][None, :]).sum(axis=1))] + ([] if one else [(b, (ok * copies[a][:, None]).sum(axis=0))])
            for rows, k in far:
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(k.astype(np.int64))], ["node", "far"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("comp", "i", "j")])
            edge = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            for x, y in zip(edge, edge[1:], strict=False):
                yield from compare(t.slice(x, y - x))
            held = t.slice(edge[-1])
        if held is not None and held.num_rows:
            yield from compare(held)
        trim()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.select(cols).unionByName(right.select(cols)).repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side")
    if pairs:
        return dealt.mapInArrow(run, "a long, b long")
    return dealt.mapInArrow(run, "node long, far long").groupBy("node").agg(F.sum("far").alias("far"))


def _components(docs: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as measured; their distinct sets; and (node, comp) of the sets that link with another."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    classes = texts.sparkSession.sparkContext.broadcast(frequency_classes(texts, size=size))
    d = materialise(measured(texts, classes, size, threshold), "measured")
    classes.destroy()
    nodes = d.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("grp").alias("grp"), F.min("bits").alias("bits"), F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "nodes")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = postings(nodes).repartition(parts, "token").sortWithinPartitions("token", "grp")
    lists = materialise(entries.mapInArrow(_lists(threshold), "kind int, a long, b long"), "lists")

    # first links: candidate groups by their first members, and each group's members in a row
    groups = nodes.groupBy("grp").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("members"))
    many = materialise(groups.where("members > 1"), "groups")
    near = materialise(lists.where("kind = 0").select("a", "b").distinct(), "near")
    first = groups.select("grp", "node")
    across = near.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    inside = nodes.select("grp", "node", F.lag("node").over(Window.partitionBy("grp").orderBy("node")).alias("b")).where("b IS NOT NULL").select(F.col("node").alias("a"), "b")
    pairs = materialise(_plausible(_ordered(across.unionByName(inside)), nodes, threshold), "pairs")

    entries = lists.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("grp")).join(nodes.select("grp", "node"), "grp").select("token", "node")
    entries = materialise(entries.unionByName(nodes.join(many.select("grp"), "grp").select(F.col("grp").alias("token"), "node")), "entries")
    wide = near.join(many.select(F.col("grp").alias("a"), F.lit(1).alias("ma")), "a", "left").join(many.select(F.col("grp").alias("b"), F.lit(1).alias("mb")), "b", "left").where("ma = 1 OR mb = 1")
    members = nodes.select("grp", "node")
    wide = materialise(wide.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "wide")

    def linked(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        elements = materialise(_elements(texts, nodes.join(need, "node", "left_semi"), size), "elements")
        return materialise(_verified(pairs, elements, threshold), "links")

    comp = components(linked(pairs))

    # second links: what else may join two components. First the nearest of each entry outside the largest component, then all that is left
    for nearest in (True, False):
        label = materialise(entries.join(comp, "node", "left").select("token", "node", F.coalesce("comp", "node").alias("comp")), "labels")
        kinds = label.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h"))
        main = kinds.groupBy("token").agg(F.max_by("comp", "k").alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("k").alias("n_all"), F.max("k").alias("n_main"), F.sum("h").alias("h")).where("kinds > 1")
        main = main.groupBy("n_all", "h").agg(F.min_by(F.struct("token", "main", "n_main"), "token").alias("x")).select("x.token", "x.main", "n_all", (F.col("n_all") - F.col("x.n_main")).alias("n_other"))  # equal lists are gone through once
        cross = _tiles(label.join(main, "token"), nodes, nearest, threshold)
        if not nearest:
            far = wide.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
            cross = cross.unionByName(_plausible(_ordered(far), nodes, threshold).select("a", "b"))
        cross = materialise(_ordered(cross), "cross")
        if cross.isEmpty():
            continue
        bridge = linked(cross).join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        over = components(bridge)
        named = comp.join(over.toDF("comp", "over"), "comp", "left").select("node", F.coalesce("over", "comp").alias("comp"))
        comp = materialise(named.unionByName(over.join(comp, "node", "left_anti")), "comps")

    return d, nodes, comp


def _members(docs: DataFrame, nodes: DataFrame, comp: DataFrame, size: int) -> DataFrame:
    """Sets that link with another, with their elements."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    m = nodes.join(comp, "node").select("comp", "node", "n", "copies", "rep")
    elements = _elements(texts, m, size).join(m.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return m.drop("rep").join(elements, "node")


def cluster(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of docs; n_links counts the other rows whose sets link with the row's, copies included."""
    d, nodes, comp = _components(docs, size, threshold)
    far = materialise(_component_links(_members(docs, nodes, comp, size), threshold, False), "far")
    whole = nodes.join(comp, "node", "left").join(far, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    least = whole.join(whole.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("node", "component_id", "n_links")
    some = F.col("n") > 0
    return d.join(least, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("n_links")).otherwise(0).alias("n_links"))


def links(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, each pair of different sets that meet the threshold, once; and (doc_id, node), the set of each row. Both are numbers of sets; rows of one set link with each other."""
    d, nodes, comp = _components(docs, size, threshold)
    return _component_links(_members(docs, nodes, comp, size), threshold, True), d.where("n > 0").select("doc_id", "node")


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, one of each component: that of the least id (null counts as the largest), of several rows with that id the one whose text has the least hash, of repeats any one. Rows of one id with unlike texts are unlike rows. Empty sets link with nothing and stay."""
    d, nodes, comp = _components(docs, size, threshold)
    named = d.where("n > 0").join(comp, "node", "left").select(F.coalesce("comp", "node").alias("comp"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("row"))
    rows = named.groupBy("comp", "row").agg(F.count(F.lit(1)).alias("k"))
    rows = materialise(rows.join(rows.groupBy("comp").agg(F.min("row").alias("stays")), "comp").select("row.doc_id", "row.mark", "k", (F.col("row") == F.col("stays")).alias("stays")), "rows")
    same = lambda x: (F.col("_x.doc_id").cast("long").eqNullSafe(x["doc_id"])) & (F.xxhash64(F.col("_x.text").cast("string")) == x["mark"])
    once = docs.alias("_x")
    gone, repeated = rows.where("NOT stays"), rows.where("stays AND k > 1")
    kept = once.join(gone, same(gone), "left_anti").alias("_x")
    single = kept.join(repeated, same(repeated), "left_anti")
    many = kept.join(repeated, same(repeated), "left_semi").withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    return single.select(*docs.columns).unionByName(many.dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) END) AS g FROM w),
d AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
lk AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT lk.y, r.c FROM r JOIN lk ON lk.x = r.doc_id WHERE r.c < lk.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id, (SELECT count(*) FROM lk WHERE lk.x = w.doc_id)::BIGINT AS n_links FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""
