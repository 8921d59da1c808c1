"""Operator 13. Byte-level BPE encoding and decoding by DuckDB's recursive queries.

Each task cuts whole texts into words by the pattern of the vocabulary and keeps the distinct ones of a block. Words that are in the vocabulary
get their id. The others become token-position rows, at first a row a byte; a recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of minimum rank until no pair is left. Decoding joins the ids with the vocabulary and aggregates the bytes
in order of position.

A round contracts the leftmost place only, or all places of the minimum rank (from the left, without overlaps) where the merged token is calm:
no merge of it with a neighbour ranks lower than itself, so the next rounds would contract just these places. A word of one repeated letter
thus takes rounds as the logarithm of its length.

Nothing is shuffled: a row's ids depend on its text alone. A worker keeps the ids of some words that it has seen (KNOWN at most, then the older
half goes), which only the speed depends on. Null and empty texts have no ids and decode to no bytes; a null doc_id stays null; repeated rows
and equal texts give equal rows each; an empty table gives none. Texts of any length are encoded whole, in slices that end where no word can
go on. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import blocks, table, trim

#: Bytes of text, and code points of a slice of a long text, that are encoded at once.
BLOCK, SLICE = 2 << 20, 1 << 20
#: Words whose ids a worker keeps; tokens that are decoded at once.
KNOWN, DECODE_ROWS = 1 << 19, 1 << 19

LETTER, NUMBER, SPACE = 1, 2, 3
#: White_Space of Unicode.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = LETTER
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "N"]] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def split(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of texts by public_tokenizers.PATTERN: the texts' UTF-8 in a row, byte offsets at which words start (and the end), and each text's first word (and the end).

    Runs of letters, numbers, white space and others are found for all texts at once; then a blank goes to the word behind it, and endings
    such as 're are cut from the letters that follow them.
    """
    joined = "".join(texts)
    u = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    if not len(u):
        return b"", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = _classes()[u]
    start = np.concatenate([[True], kind[1:] != kind[:-1]])
    start[at[:-1][at[:-1] < len(u)]] = True
    run = np.flatnonzero(start)
    end = np.append(run[1:], len(u))
    own = np.zeros(len(u) + 1, bool)  # where texts start
    own[at] = True
    s, e = run[kind[run] == SPACE], end[kind[run] == SPACE]
    s, e = s[~own[e]], e[~own[e]]
    start[e - 1] = True
    start[e[u[e - 1] == 0x20]] = False
    p = run[(end - run == 1) & (u[run] == 0x27)]
    p = p[~own[p + 1]]
    p = p[own[p] | (u[p - 1] != 0x20)]
    p = p[kind[p + 1] == LETTER]
    stop = np.append(run, len(u))[np.searchsorted(run, p + 1, "right")]
    a, b = u[p + 1], np.where(p + 2 < stop, u[np.minimum(p + 2, len(u) - 1)], 0)
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    size = np.where(np.isin(a, [ord(c) for c in "stmd"]), 2, np.where(two, 3, 0))
    p, stop, size = p[size > 0], stop[size > 0], size[size > 0]
    start[p + 1] = False
    cut = p + size
    start[cut[cut < stop]] = True
    first = np.flatnonzero(start)
    width = 1 + (u >= 0x80).astype(np.int64) + (u >= 0x800) + (u >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width)])
    return joined.encode(), byte[np.append(first, len(u))], np.searchsorted(first, at)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A long text in slices that end behind a character and before white space, where a word ends whatever stands around."""
    while len(text) > size:
        u = np.frombuffer(text.encode("utf-32-le"), "<u4")
        white = _classes()[u] == SPACE
        edge = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        at = 0
        while len(u) - at > size:
            k = np.searchsorted(edge, at + size)
            if k == len(edge):
                break
            yield text[at : edge[k]]
            at = int(edge[k])
        text = text[at:]
        break
    yield text


#: The pairs of neighbours that merge, the best rank of each word and its places; then the words' rows after the contraction.
_RECURSION = """
WITH RECURSIVE step AS (
    SELECT w, g, 1 AS len, tok, 0 AS round FROM fresh
    UNION ALL
    (WITH pairs AS (
        SELECT a.w, a.g, b.g AS g2, a.len + b.len AS len, m.id, m.calm
        FROM step a JOIN step b ON b.g = a.g + a.len JOIN merges m ON m.pair = (a.tok::BIGINT << 32) + b.tok
    ), best AS (
        SELECT w, min(id) AS id FROM pairs GROUP BY w
    ), places AS (
        SELECT p.*, row_number() OVER o AS k, lag(p.g2) OVER o IS DISTINCT FROM p.g AS apart, lag(p.w) OVER o IS DISTINCT FROM p.w AS leftmost
        FROM pairs p JOIN best USING (w, id) WINDOW o AS (ORDER BY p.g)
    ), runs AS (
        SELECT *, max(CASE WHEN apart THEN k END) OVER (ORDER BY g) AS run FROM places
    ), hits AS (
        SELECT g, g2, len, id FROM runs WHERE CASE WHEN calm THEN (k - run) % 2 = 0 ELSE leftmost END
    )
    SELECT s.w, s.g, coalesce(h.len, s.len), coalesce(h.id, s.tok), s.round + 1
    FROM step s SEMI JOIN best USING (w) LEFT JOIN hits h ON h.g = s.g ANTI JOIN hits gone ON gone.g2 = s.g)
)
SELECT w, tok FROM step SEMI JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round) ORDER BY g
"""
#: The bytes of a block's ids in order of position, one aggregate for all rows of the block; offsets tell the rows apart.
_DECODE = "SELECT list(spelling ORDER BY pos) AS parts FROM ids JOIN vocabulary USING (id)"


class Coder:
    """The vocabulary of a rank file (base64 of a token's bytes and its rank a line) in a DuckDB connection of this process."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self._put("vocabulary", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "spelling": pa.array(list(self.ranks), pa.binary())}))
        self.byte: np.ndarray | None = None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _put(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.con.unregister("rows")

    def _merges(self) -> None:
        """The merge table: pairs of tokens whose bytes together are a token. Only workers that encode need it."""
        ranks = self.ranks
        cut = np.array([(ranks[t[:i]], ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64).reshape(-1, 3)
        left, right, merged = cut.T
        restless = np.union1d(left[merged < left], right[merged < right])
        self._put("merges", pa.table({"pair": (left << 32) + right, "id": merged.astype(np.int32), "calm": ~np.isin(merged, restless)}))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words (little-endian unsigned 32-bit) by the recursive query."""
        if self.byte is None:
            self._merges()
        size = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        g = np.arange(len(w)) + w  # positions of a word follow each other, those of two words never do
        self.con.register("fresh", pa.table({"w": w, "g": g, "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}))
        out = self.con.sql(_RECURSION).to_arrow_table()
        self.con.unregister("fresh")
        ids = out.column("tok").to_numpy().astype("<u4").tobytes()
        at = 4 * np.searchsorted(out.column("w").to_numpy(), np.arange(len(words) + 1))
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, from those seen before, the vocabulary or the merges."""
        out: list[bytes | None] = []
        for x in words:
            y = self.known.get(x)
            if y is None and (y := self.older.get(x)) is not None:
                self.known[x] = y
            out.append(y)
        fresh = [i for i, y in enumerate(out) if y is None]
        whole = [(i, self.ranks.get(words[i])) for i in fresh]
        for i, k in whole:
            if k is not None:
                out[i] = k.to_bytes(4, "little")
        rest = [i for i, k in whole if k is None]
        for i, y in zip(rest, self._contract([words[i] for i in rest]) if rest else [], strict=True):
            out[i] = y
        for i in fresh:
            if len(words[i]) <= 64:
                self.known[words[i]] = out[i]
        if len(self.known) > KNOWN // 2:
            self.known, self.older = {}, self.known
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        buf, offset, first = split(texts)
        if not buf:
            return [b""] * len(texts)
        words = pa.Array.from_buffers(pa.large_binary(), len(offset) - 1, [None, pa.py_buffer(offset.astype(np.int64)), pa.py_buffer(buf)]).dictionary_encode()
        ids = pa.array(self.words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[first]
        data = ids.buffers()[2]
        return [data[a : b].to_pybytes() for a, b in zip(at, at[1:])]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids; an id that the vocabulary lacks is an error."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if not len(flat):
            return [b""] * len(ids)
        self.con.register("ids", pa.table({"pos": np.arange(len(flat)), "id": flat.astype(np.int64)}))
        parts = self.con.sql(_DECODE).to_arrow_table().combine_chunks().column("parts").chunk(0).values
        self.con.unregister("ids")
        if len(parts) != len(flat):
            raise ValueError("ids that the vocabulary lacks")
        edge = np.frombuffer(parts.buffers()[1], np.int64 if pa.types.is_large_binary(parts.type) else np.int32)[parts.offset :]
        at = edge[np.concatenate([[0], np.cumsum(np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids)))])]
        data = parts.buffers()[2]
        return [data[x:y].to_pybytes() for x, y in zip(at, at[1:])]


_coders: dict[str, Coder] = {}


def coder(path: str | None = None) -> Coder:
    """This process's coder of a rank file; by default public_tokenizers' byte_bpe_multi_50k."""
    import public_tokenizers as P

    path = path or P.path("byte_bpe_multi_50k.tiktoken")
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and slices of their texts, about BLOCK characters at once."""
    rows, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for x in slices(t or ""):
            rows.append(i)
            parts.append(x)
            size += len(x)
            if size >= BLOCK:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in blocks(batches, 1, BLOCK):
            out: list[list[bytes]] = [[] for _ in range(b.num_rows)]
            for rows, parts in _groups(b.column(1).to_pylist()):
                for i, ids in zip(rows, c.encode(parts), strict=True):
                    out[i].append(ids)
            ids = [b"".join(x) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes of each row's ids; null ids have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in blocks(batches, 2, 4 * DECODE_ROWS):
            got = c.decode([x or b"" for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])
        trim()

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
