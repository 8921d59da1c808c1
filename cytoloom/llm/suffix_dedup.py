"""Operator 7. Suffix-array dedup with a logarithmic index family.

A byte goes if a WIDTH-byte string over it also starts in a document with a smaller id. Every window of WIDTH bytes belongs to the suffix
that starts at its minimiser (the least hash among its GRAM-byte strings, the leftmost of equals), so equal windows belong to suffixes with
equal starts: a sparse suffix array suffices, with one entry for each run of windows that share a minimiser. Entries are ordered by digests
(of the suffix's first GRAM bytes, and of all bytes that its windows cover), which sorts equal suffixes together as byte order would.

The index is a `Family` of levels in the shared folder, each a table sorted by (gram, whole) and bucketed by gram. Documents come in batches
of rising ids. 1. A batch is packed into compressed chunks, a table bucketed by chunk that stays beside the levels. 2. Its suffix array (of each
chunk the distinct entries, least document first) is dealt to the levels' buckets and merge-scanned against all levels at once: buckets are read
where they lie, only the batch is shuffled. An entry found in a level or under a smaller id is covered whole; first entries become the new
level. 3. First entries whose suffix start also has other continuations match in part, at the edges of copies, if a longer start agrees too (33 or
34 bytes, of the side on which a window reaches further; a 16-bit digest of each tells most chance meetings apart). Their bytes, and those that
level entries point to, are dealt by that longer start and compared window by window.
4. Chunks turn what was found into removed runs. Before a batch is scanned, the newest levels merge while one is less than twice the size of the next, so n
batches leave about log2(n) levels. `Family.open` takes an index up again in another session.

Every step is linear in entries: rows, no blob for each pair of chunk and shard. A task streams sorted rows and holds one suffix start at a time.

Null text is empty. A null doc_id counts as larger than any other. Rows with equal ids never match each other. Short and empty texts
lose nothing; an empty table gives no rows. Strings are judged on the input. Two entries are equal if 96 bits of digest agree (some 3 in 10^4 for a
chance match anywhere among 10^13 entries), two windows if 128 bits do. Texts of any length are cut in blocks, never shortened. Extra columns,
whatever their names, are left out by `digests` and `deduplicate` and carried by `rewrite`.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop_path, free, materialise, new_path, small_batches, table, text_bytes, trim

WIDTH, GRAM, BATCHES = 50, 16, 2
#: Bytes of text in a chunk, windows in a block, rows that a task gathers before it compares.
CHUNK_BYTES, STEP, ROWS = 2 << 20, 1 << 18, 1 << 17
#: Windows reach at least SIDE bytes beyond the suffix's start on the left, or else more than that on the right.
SIDE = (WIDTH - GRAM) // 2
LAST, EARLIER = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_R = 0x9E3779B97F4A7C15 | 1
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A chunk's number: batch, task, place. An entry's spot: first byte, bytes before the minimiser, windows less one.
_BATCH, _TASK, _AT, _N = 44, 24, 12, 6


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value of each byte, powers of the base and of its inverse modulo 2^64, for blocks of STEP windows."""
    if not hasattr(_tables, "done"):
        from .base import mix

        n = STEP + 2 * WIDTH + 1
        powers = [np.full(n, b, np.uint64) for b in (_R, pow(_R, -1, 1 << 64))]
        for p in powers:
            p[0] = 1
        _tables.done = (mix(np.arange(1, 257, dtype=np.uint64)), *(np.cumprod(p, dtype=np.uint64) for p in powers))
    return _tables.done


def _prefix(buf: np.ndarray) -> np.ndarray:
    value, power, _ = _tables()
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * power[: len(buf)], out=s[1:])
    return s


def entries(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sparse suffix array of concatenated documents, in text order: document, first window, number of windows, bytes before the minimiser, digest of the suffix's start (32 bits), digest of the bytes covered (64 bits), and of the two longer starts (16 bits each, 0 where no window reaches that side)."""
    _, _, inverse = _tables()
    out: list[tuple] = []
    low = np.uint64((1 << 24) - 1)
    for a in range(0, max(0, len(buf) - WIDTH + 1), STEP):
        part = buf[a : a + STEP + WIDTH - 1]
        n = len(part) - WIDTH + 1
        s = _prefix(part)
        m = len(part) - GRAM + 1
        h = (s[GRAM : GRAM + m] - s[:m]) * inverse[:m] * _C1
        h ^= h >> np.uint64(32)
        h *= _C2
        key = (h & ~low) | np.arange(m, dtype=np.uint64)
        span, w = 1, WIDTH - GRAM + 1
        while 2 * span <= w:  # least over twice the span each time
            np.minimum(key[: len(key) - span], key[span:], out=key[: len(key) - span])
            key = key[: len(key) - span]
            span *= 2
        least = np.minimum(key[:n], key[w - span : w - span + n])
        at = (least & low).astype(np.int64)
        doc = np.searchsorted(ends, np.arange(a, a + n), "right")
        ok = a + np.arange(n) + WIDTH <= ends[doc]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & ok)
        stop = np.append(np.flatnonzero(new | ~ok), n)
        count = stop[np.searchsorted(stop, first, "right")] - first
        whole = (s[first + count + WIDTH - 1] - s[first]) * inverse[first] * _C1
        whole ^= whole >> np.uint64(31)
        whole = (whole + (at[first] - first).astype(np.uint64)) * _C2
        p = at[first]
        sides = _longer(s, inverse, p - SIDE, GRAM + SIDE, first <= p - SIDE) << np.uint32(16) | _longer(s, inverse, p, WIDTH - SIDE + 1, first + count > p - SIDE + 1)
        out.append((doc[first], a + first, count, p - first, (h[p] >> np.uint64(32)).astype(np.uint32), whole ^ (whole >> np.uint64(29)), sides))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint64, np.uint32))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _longer(s: np.ndarray, inverse: np.ndarray, at: np.ndarray, n: int, reached: np.ndarray) -> np.ndarray:
    """16-bit digests, from 1, of n bytes from each place; 0 where they aren't reached."""
    at = np.where(reached, at, 0)
    x = (s[np.minimum(at + n, len(s) - 1)] - s[at]) * inverse[at] * _C1
    x ^= x >> np.uint64(30)
    return np.where(reached, (x * _C2 >> np.uint64(48)) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint32)


class Text:
    """A chunk's documents."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids, self.sizes = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.raw = zstandard.ZstdDecompressor().decompress(text, max_output_size=int(self.sizes.sum()) or 1) if text else b""
        self.ends = np.cumsum(self.sizes)


class Chunk(Text):
    """A chunk with its suffix array. `order` sorts entries by digests and document; `group` numbers equal digests; `rep` is the first entry of each group, of its least document."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        super().__init__(ids, sizes, text)
        doc, self.at, self.count, self.before, self.gram, self.whole, self.sides = entries(np.frombuffer(self.raw, np.uint8), self.ends)
        self.owner = self.ids[doc]
        self.order = np.lexsort((self.owner, self.whole, self.gram))
        g, w = self.gram[self.order], self.whole[self.order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        self.rep = self.order[new]
        self.group = np.empty(len(g), np.int64)
        self.group[self.order] = np.cumsum(new) - 1


_STORE = "batch int, chunk long, ids binary, sizes binary, text binary, rest binary"
_ENTRY = "gram int, whole long, doc long, chunk long, spot long, sides int"
_FOUND = "gram int, whole long, chunk long, spot long, sides int, kind int"
_PARTS = "ext long, doc long, chunk long, at long, text binary"
_MASKS = "chunk long, at long, mask long"


def _packer(others: list[str], bounds: np.ndarray, first: int, chunk_bytes: int):
    """Rows to chunks: of each batch of ids its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, part = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId()
        open_: dict[int, tuple[list, list, list]] = {}
        made: dict[int, int] = {}

        def out(k: int) -> pa.RecordBatch:
            ids, held, rest = open_.pop(k)
            made[k] = made.get(k, 0) + 1
            number = ((first + k) << _BATCH) + (part << _TASK) + made[k]
            return _arrow([(first + k, number, np.array(ids, np.int64).tobytes(), np.array([len(x) for x in held], np.int64).tobytes(), z.compress(b"".join(held)), _stream(rest) if others else None)], _STORE)

        size: dict[int, int] = {}
        for b in batches:
            b = b.set_column(0, "_id", b.column(0).fill_null(int(LAST)))
            of = np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False), "left")
            for k in np.unique(of).tolist():
                mine = b.take(pa.array(np.flatnonzero(of == k)))
                begin = 0
                for i, (doc, t) in enumerate(zip(mine.column(0).to_pylist(), text_bytes(mine.column(1)), strict=True)):
                    ids, held, rest = open_.setdefault(k, ([], [], []))
                    ids.append(doc)
                    held.append(t)
                    size[k] = size.get(k, 0) + len(t)
                    if size[k] >= chunk_bytes or i + 1 == mine.num_rows:
                        if others:
                            rest.append(pa.RecordBatch.from_arrays(mine.columns[2:], others).slice(begin, i + 1 - begin))
                        begin = i + 1
                    if size[k] >= chunk_bytes:
                        size[k] = 0
                        yield out(k)
        for k in list(open_):
            yield out(k)

    return run


def _stream(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as w:
        for x in parts:
            w.write_batch(x)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _arrow(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _columns(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in names.split(", ")])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[i].as_py() if not pa.types.is_list(c.type) else c[i].values for n, c in zip(b.schema.names, b.columns, strict=True)}
    trim()


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct entries."""
    for r in _rows(batches):
        c = Chunk(r["ids"], r["sizes"], r["text"])
        u = np.sort(c.rep)
        spot = c.at[u] << _AT | c.before[u] << _N | (c.count[u] - 1)
        yield _columns(_ENTRY, c.gram[u].view(np.int32), c.whole[u].view(np.int64), c.owner[u], np.full(len(u), r["chunk"]), spot, c.sides[u].view(np.int32))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scan(batch: int, rows: int = ROWS):
    """Merge scan of a bucket: entries of the batch and of all levels in the order of (gram, whole, document). Kinds of rows given: 0 new to the index, 1 covered whole, 2 of the batch and 3 of a level where one suffix start has several continuations and a longer start (sides: 1 left, 2 right) is shared by some."""

    def step(cols: tuple[np.ndarray, ...], end: int) -> Iterator[pa.RecordBatch]:
        gram, whole, doc, chunk, spot, sides = cols
        level = chunk >> _BATCH != batch
        edge = np.ones(len(gram), bool)
        edge[1:] = gram[1:] != gram[:-1]
        new = edge.copy()
        new[1:] |= whole[1:] != whole[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        covered = ~level & ~new & (level[first] | (doc > doc[first]))
        alive = ~level & ~covered
        done = np.arange(len(gram)) < end
        p = np.flatnonzero(covered)
        if len(p):
            zero = np.zeros(len(p), np.int64)
            yield _columns(_FOUND, zero.astype(np.int32), zero, chunk[p], spot[p], zero.astype(np.int32), np.ones(len(p), np.int32))
        p = np.flatnonzero(done & alive & new)
        if len(p):
            yield _columns(_FOUND, gram[p], whole[p], chunk[p], spot[p], sides[p], np.zeros(len(p), np.int32))
        start = np.flatnonzero(edge)
        group = np.cumsum(edge) - 1
        several = (np.add.reduceat(new.astype(np.int64), start) > 1) & (np.add.reduceat(alive.astype(np.int64), start) > 0)
        c = np.flatnonzero(done & several[group] & (alive | (level & new)))
        if len(c):
            shared = np.zeros(len(c), np.int32)
            for side in (1, 2):  # which longer starts stand in several continuations, one of them the batch's
                longer = sides[c].view(np.uint32) >> np.uint32(16 * (2 - side)) & np.uint32(0xFFFF)
                key = group[c] << 16 | longer
                o = np.argsort(key, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], key[o][1:] != key[o][:-1]]))
                ok = (np.add.reduceat(new[c][o].astype(np.int64), cut) > 1) & (np.add.reduceat(alive[c][o].astype(np.int64), cut) > 0)
                shared[o] |= np.where(np.repeat(ok, np.diff(np.append(cut, len(o)))) & (longer[o] > 0), np.int32(side), np.int32(0))
            c, shared = c[shared > 0], shared[shared > 0]
        if len(c):
            zero = np.zeros(len(c), np.int64)
            yield _columns(_FOUND, zero.astype(np.int32), zero, chunk[c], spot[c], shared, np.where(level[c], 3, 2).astype(np.int32))
        keep = np.flatnonzero(~done & ~covered)
        return tuple(x[keep] for x in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64, np.int64, np.int32))
        for part in _gathered(batches, rows):
            held = tuple(np.concatenate([x, *(b.column(i).to_numpy() for b in part)]) for i, x in enumerate(held))
            if len(held[0]):
                held = yield from step(held, int(np.flatnonzero(held[0] != held[0][-1])[-1:].sum() + 1) if held[0][0] != held[0][-1] else 0)
        if len(held[0]):
            yield from step(held, len(held[0]))
        trim()

    return run


def _ask(batch: int):
    """Bytes of entries that may match in part, in two runs of windows: those that reach SIDE bytes or more to the left of the suffix's start, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            t = Text(r["ids"], r["sizes"], r["text"])
            spot, of = np.unique(r["spots"].field(0).to_numpy(zero_copy_only=False), return_index=True)
            sides = r["spots"].field(1).to_numpy(zero_copy_only=False)[of]
            at, before, count = spot >> _AT, spot >> _N & ((1 << _N) - 1), (spot & ((1 << _N) - 1)) + 1
            owner = t.ids[np.searchsorted(t.ends, at, "right")] if r["chunk"] >> _BATCH == batch else np.full(len(at), EARLIER)
            p = at + before
            cut = np.clip(p - SIDE + 1, at, at + count)
            out: list[tuple] = []
            for side, lo, hi, a, b in ((1, at, cut, p - SIDE, p + GRAM), (2, cut, at + count, p, p + WIDTH - SIDE + 1)):
                k = np.flatnonzero((hi > lo) & (sides & side > 0))
                out += [(xxhash.xxh64_intdigest(t.raw[x:y]) - (1 << 63), o, r["chunk"], f, t.raw[f : g + WIDTH - 1]) for x, y, o, f, g in zip(a[k].tolist(), b[k].tolist(), owner[k].tolist(), lo[k].tolist(), hi[k].tolist(), strict=True)]
            if out:
                yield _arrow(out, _PARTS)

    return run


def _window_keys(text: list[bytes]) -> np.ndarray:
    """Digest of each window of each text."""
    size = np.fromiter(map(len, text), np.int64, len(text))
    stop = np.cumsum(size)
    buf = np.frombuffer(b"".join(text), np.uint8)
    out, i = [], 0
    while i < len(text):  # blocks that the tables of powers reach
        base = stop[i] - size[i]
        j = max(i + 1, int(np.searchsorted(stop, base + STEP, "right")))
        s, inverse = _prefix(buf[base : stop[j - 1]]), _tables()[2]
        n = size[i:j] - WIDTH + 1
        p = np.repeat(stop[i:j] - size[i:j] - base - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x = (s[p + WIDTH] - s[p]) * inverse[p] * _C1
        x ^= x >> np.uint64(32)
        out.append(x * _C2)
        i = j
    return np.concatenate(out)


def _compare(rows: int = ROWS):
    """Windows of rows in the order of (ext, doc): those that also start in an earlier document under the same ext, as bits."""

    def step(ext, doc, chunk, at, text) -> Iterator[pa.RecordBatch]:
        edge = np.ones(len(ext), bool)
        edge[1:] = ext[1:] != ext[:-1]
        number = np.cumsum(edge) - 1
        ask = np.flatnonzero(doc > doc[np.flatnonzero(edge)][number])
        use = np.flatnonzero(np.isin(number, number[ask]))  # groups of one document match nothing
        if not len(use):
            return
        n = np.fromiter((len(text[i]) - WIDTH + 1 for i in use), np.int64, len(use))
        key = _window_keys([text[i] for i in use])
        row = np.repeat(np.arange(len(use)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        d, g = doc[use][row], number[use][row]
        o = np.lexsort((d, key, g))
        k, gg = key[o], g[o]
        new = np.ones(len(o), bool)
        new[1:] = (k[1:] != k[:-1]) | (gg[1:] != gg[:-1])
        hit = np.empty(len(o), bool)
        hit[o] = d[o[np.flatnonzero(new)[np.cumsum(new) - 1]]] < d[o]
        mask = np.add.reduceat(np.where(hit, np.int64(1) << place, 0), np.cumsum(n) - n)
        got = np.flatnonzero(mask)
        if len(got):
            yield _columns(_MASKS, chunk[use[got]], at[use[got]], mask[got])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in _gathered(batches, rows):
            t = pa.Table.from_batches(part if held is None else [*held, *part])
            ext = t.column(0).to_numpy()
            end = int(np.searchsorted(ext, ext[-1])) if len(ext) else 0
            if end:
                x = t.slice(0, end)
                yield from step(*(x.column(i).to_numpy() for i in range(4)), x.column(4).to_pylist())
            held = t.slice(end).combine_chunks().to_batches()
        if held:
            x = pa.Table.from_batches(held)
            yield from step(*(x.column(i).to_numpy() for i in range(4)), x.column(4).to_pylist())

    return run


def _cutter(emit):
    """Covered bytes of a chunk, handed to emit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            c = Chunk(r["ids"], r["sizes"], r["text"])
            found = np.zeros(len(c.rep), bool)
            if r["spots"] is not None:
                found[c.group[np.searchsorted(c.at, r["spots"].to_numpy(zero_copy_only=False) >> _AT)]] = True
            least = c.owner[c.rep]
            full = found[c.group] | (c.owner > least[c.group]) if len(c.rep) else found
            delta = np.zeros(len(c.raw) + 1, np.int32)
            np.add.at(delta, c.at[full], 1)
            np.add.at(delta, c.at[full] + c.count[full] + WIDTH - 1, -1)
            if r["masks"] is not None:
                at, mask = (r["masks"].field(i).to_numpy(zero_copy_only=False) for i in range(2))
                e = np.searchsorted(c.at, at, "right") - 1
                row, bit = np.nonzero(mask[:, None] >> np.arange(WIDTH - GRAM + 1) & 1)
                # the windows found, relative to their entry, hold for all entries of the same bytes that aren't covered
                mine = np.flatnonzero(~full)
                mine = mine[np.argsort(c.group[mine], kind="stable")]
                g = c.group[mine]
                lo, hi = np.searchsorted(g, c.group[e[row]]), np.searchsorted(g, c.group[e[row]], "right")
                k = hi - lo
                member = mine[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                q = c.at[member] + np.repeat(at[row] - c.at[e[row]] + bit, k)
                np.add.at(delta, q, 1)
                np.add.at(delta, q + WIDTH, -1)
            yield from emit(c.ids, c.raw, np.cumsum(delta[:-1]) > 0, c.ends, r.get("rest"))

    return run


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Family:
    """The index family: levels of entries and the chunks that they point to, in one folder. `levels` lists (name of the folder, rows), oldest first; `stores` the chunk tables."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "family")
        self.buckets = min(100_000, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[tuple[str, int]] = []
        self.stores: list[tuple[int, str]] = []
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Family:
        """An index written before, also by another session."""
        rows = spark.read.schema("version long, kind string, place int, name string, size long, buckets int").json(f"{path}/manifest").collect()
        rows = [r for r in rows if r.version == max(x.version for x in rows)]
        f = cls(spark, path, rows[0].buckets)
        f.levels = [(r.name, r.size) for r in sorted((r for r in rows if r.kind == "level"), key=lambda r: r.place)]
        f.stores = [(r.size, r.name) for r in sorted((r for r in rows if r.kind == "store"), key=lambda r: r.place)]
        return f

    def _save(self) -> None:
        rows = [("level", i, n, s) for i, (n, s) in enumerate(self.levels)] + [("store", i, n, b) for i, (b, n) in enumerate(self.stores)]
        version = time.time_ns()  # the latest manifest counts; it is written when all that it names is
        out = self.spark.createDataFrame([(version, *r, self.buckets) for r in rows], "version long, kind string, place int, name string, size long, buckets int")
        out.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _write(self, df: DataFrame, name: str, key: str, by: str) -> None:
        """A folder partitioned by a column and bucketed by another. Rows come dealt by bucket, so a task has few files open and needn't sort again."""
        t = f"cytoloom_{uuid.uuid4().hex[:12]}"
        with _setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):
            plain = {"parquet.enable.dictionary": "false", "parquet.enable.dictionary#chunk": "true"}  # digests and places don't repeat
            df.write.options(**plain).option("path", f"{self.path}/{name}").option("compression", "zstd" if by == "kind" else "none").partitionBy(by).bucketBy(self.buckets, key).format("parquet").saveAsTable(t)
        self.spark.sql(f"DROP TABLE {t}")

    def _table(self, name: str, schema: str, key: str) -> DataFrame:
        """A bucketed folder as a table: joins on its key don't shuffle it."""
        if name not in self.tables:
            t = f"cytoloom_{uuid.uuid4().hex[:12]}"
            self.spark.sql(f"CREATE TABLE {t} ({schema}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = self.spark.table(t)
        return self.tables[name]

    def _level(self, name: str) -> DataFrame:
        return self._table(f"{name}/kind=0", "gram int, whole long, chunk long, spot long, sides int", "gram")

    def chunks(self, batch: int) -> DataFrame:
        name = dict(self.stores)[batch]
        return self._table(name, "chunk long, ids binary, sizes binary, text binary, rest binary", "chunk")

    def pack(self, docs: DataFrame, batches: int = 1, chunk_bytes: int = CHUNK_BYTES, carry: bool = False) -> list[int]:
        """Writes the documents' chunks, in batches of rising ids; with carry, all columns but text go along. Returns the batches' numbers."""
        others = [c for c in docs.columns if c != "text"] if carry else []
        first = 1 + max((b for b, _ in self.stores), default=-1)
        ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("_id"))
        cuts = ids.approxQuantile("_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
        bounds = np.unique([min(int(x), int(LAST)) for x in cuts]).astype(np.int64)
        rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
        name = f"chunks-{first}"
        self._write(rows.mapInArrow(_packer(others, bounds, first, chunk_bytes), _STORE).repartition(self.buckets, "chunk"), name, "chunk", "batch")
        made = [r[0] for r in self.spark.read.schema("batch int").parquet(f"{self.path}/{name}").select("batch").distinct().collect()]
        self.stores += [(b, f"{name}/batch={b}") for b in sorted(made)]
        return sorted(made)

    def _together(self, frames: list[DataFrame]) -> DataFrame:
        """Rows of equally bucketed frames in one partition for each bucket, without a shuffle where Spark can see that they are."""
        u = reduce(DataFrame.unionByName, frames)
        if not u._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith("hashpartitioning"):
            u = u.repartition(self.buckets, "gram")
        return u

    def _merge(self) -> None:
        """Merges the newest levels while one is less than twice the size of the next."""
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            (a, n), (b, m) = self.levels[-2:]
            name = f"level-{uuid.uuid4().hex[:8]}"
            both = self._together([self._level(x).select("gram", "whole", "chunk", "spot", "sides", F.lit(0).alias("kind")) for x in (a, b)])
            self._write(both.sortWithinPartitions("gram", "whole"), name, "gram", "kind")
            self.levels[-2:] = [(name, n + m)]
            self._save()
            for x in (a, b):
                drop_path(self.spark, f"{self.path}/{x}/kind=0")

    def add(self, batch: int) -> DataFrame:
        """Scans a packed batch against the levels and makes it one. Returns its chunks with what was found: spots of entries covered whole, masks of windows."""
        spark = self.spark
        with _setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):  # else bucketed tables under a union are read without their buckets
            self._merge()
            mine = self.chunks(batch).select("chunk", "ids", "sizes", "text").mapInArrow(_send, _ENTRY).repartition(self.buckets, "gram")
            levels = [self._level(n).select("gram", "whole", F.lit(int(EARLIER)).alias("doc"), "chunk", "spot", "sides") for n, _ in self.levels]
            name = f"level-{uuid.uuid4().hex[:8]}"
            with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "32768"):
                self._write(self._together([mine, *levels]).sortWithinPartitions("gram", "whole", "doc", "chunk").mapInArrow(_scan(batch), _FOUND), name, "gram", "kind")
            free(spark)
            found = spark.read.schema(_FOUND).parquet(f"{self.path}/{name}")
            size = found.where("kind = 0").count()
            if size:
                self.levels.append((name, size))
            self._save()
            spots = lambda kinds, what="spot": found.where(kinds).groupBy("chunk").agg(F.collect_list(what).alias("spots"))
            asked = lambda b: self.chunks(b).select("chunk", "ids", "sizes", "text").join(spots(f"kind >= 2 AND shiftright(chunk, {_BATCH}) = {b}", F.struct("spot", "sides")), "chunk")  # noqa: E731  each chunk table by itself: only the places are shuffled
            parts = reduce(DataFrame.unionByName, [asked(b).mapInArrow(_ask(batch), _PARTS) for b, _ in self.stores if b <= batch])
            masks = materialise(parts.repartition(self.buckets, "ext").sortWithinPartitions("ext", "doc").mapInArrow(_compare(), _MASKS), "masks")
        masks = masks.groupBy("chunk").agg(F.collect_list(F.struct("at", "mask")).alias("masks"))
        free(spark)
        return self.chunks(batch).join(spots("kind = 1"), "chunk", "left").join(masks, "chunk", "left")


def removed(docs: DataFrame, emit, schema, batches: int = BATCHES, chunk_bytes: int = CHUNK_BYTES, carry: bool = False, family: Family | None = None) -> DataFrame:
    """Finds the bytes to remove. emit(ids, texts, covered, ends, rest) makes output rows of a chunk; covered has a flag for each byte. With a family, its documents count as earlier ones, and it takes the new ones in."""
    spark = docs.sparkSession
    small_batches(spark)
    family = family or Family(spark)
    out = [family.add(b).mapInArrow(_cutter(emit), schema) for b in family.pack(docs, batches, chunk_bytes, carry)]
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_TEXTS = "doc_id long, n_bytes long, n_removed long, kept binary"


def _each(ids: np.ndarray, raw: bytes, covered: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    at = 0
    for i, to in zip(ids.tolist(), ends.tolist(), strict=True):
        c = covered[at:to]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
        kept, b = [], at
        for x, y in zip((edges[::2] + at).tolist(), (edges[1::2] + at).tolist(), strict=True):
            kept.append(raw[b:x])
            b = y
        yield None if i == LAST else i, to - at, int(c.sum()), len(edges) // 2, b"".join([*kept, raw[b:to]])
        at = to


def _digests(*a) -> Iterator[pa.RecordBatch]:
    rows = [(i, n, r, s, hashlib.sha256(kept).hexdigest()) for i, n, r, s, kept in _each(*a[:4])]
    if rows:
        yield _arrow(rows, _DIGEST)


def _kept(*a) -> Iterator[pa.RecordBatch]:
    rows = [(i, n, r, kept) for i, n, r, _, kept in _each(*a[:4])]
    if rows:
        yield _arrow(rows, _TEXTS)


def digests(docs: DataFrame, **how) -> DataFrame:
    return removed(docs, _digests, _DIGEST, **how)


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept): the remaining bytes of each document."""
    return removed(docs, _kept, _TEXTS, **how)


def rewrite(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all their columns, less the repeated bytes of text (and less characters of which only a part is left). n_chars, where there is one, follows. Rows of which nothing but white space is left go."""
    schema, names = docs.schema, docs.columns

    def emit(ids, raw, covered, ends, rest) -> Iterator[pa.RecordBatch]:
        other = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest)).read_all() if rest else None
        texts = [kept.decode("utf-8", "ignore") for *_, kept in _each(ids, raw, covered, ends)]
        lost = np.array([r > 0 for _, _, r, _, _ in _each(ids, raw, covered, ends)])
        keep = ~(lost & np.array([not t.strip() for t in texts]))
        cols = []
        for c in names:
            if c == "text":
                cols.append(pa.array(texts, pa.string()))
            elif c == "n_chars" and pa.types.is_integer(other[c].type):
                old = other[c].to_pylist()
                cols.append(pa.array([len(t) if x else y for t, x, y in zip(texts, lost, old, strict=True)], other[c].type))
            else:
                cols.append(other[c].combine_chunks())
        yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return removed(docs, emit, schema, carry=True, **how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
