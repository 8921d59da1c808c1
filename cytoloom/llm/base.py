"""What the operators share: the scratch folder, the tokenizer, block-wise Arrow reading, word splitting."""

from __future__ import annotations

import base64
import ctypes
import functools
import gc
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
BLOCK_BYTES = 1 << 20
#: Rows that Spark hands to Python at once, where the session leaves its own default of 10,000: documents are long.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary one if Spark runs in one process, as in tests; else an error, since executors can't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cytoloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Folders made in the shared folder and not yet dropped.
_made: list[str] = []


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/cytoloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    jpath, fs = _filesystem(spark, path)
    fs.deleteOnExit(jpath)
    _made.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder that new_path named, or a part of it."""
    jpath, fs = _filesystem(spark, path)
    fs.delete(jpath, True)


def release(spark: SparkSession, mark: int, keep: DataFrame) -> int:
    """Removes the folders named since the mark (see made()) and the shuffles and broadcasts that nothing refers to, but for folders that keep reads. Returns a new mark."""
    files = keep.inputFiles()
    for path in _made[mark:]:
        name = path.rpartition("/cytoloom/")[2]
        if not any(f"/cytoloom/{name}/" in f for f in files):
            drop_path(spark, path)
            _made.remove(path)
    free(spark)
    return len(_made)


def free(spark: SparkSession) -> None:
    """Lets Spark remove shuffles and broadcasts that nothing refers to; it does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def made() -> int:
    return len(_made)


def materialise(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], size_column: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about `limit` bytes of text each, so memory follows no batch setting."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(size_column)
        off = np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trim() -> None:
    """Gives what a worker has freed back to the system: workers outlive their task, and the next one's JVM needs the memory."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 of each row; null is empty."""
    return [b"" if x is None else x for x in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


_ENCODINGS: dict[tuple, object] = {}


def encoding(ranks: str | None = None, added: str | None = None):
    """Encoder of texts: byte-level BPE of the rank file at `ranks`, with the added tokens of the tokenizer file at `added` (JSON); by default those of public_tokenizers' byte_bpe_50k.

    Ids equal those of that JSON file's tokenizer called with add_special_tokens=False, added tokens that stand in a text included (tests compare them).
    """
    import public_tokenizers as P
    import tiktoken

    if ranks is None:
        ranks, added = P.path("byte_bpe_50k.tiktoken"), added or P.path("byte_bpe_50k.json")
    if (ranks, added) not in _ENCODINGS:
        special = {}
        if added:
            with open(added, encoding="utf-8") as f:
                tokens = json.load(f)["added_tokens"]
            if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokens):
                raise ValueError(f"{added}: added tokens that strip or match whole words only are not supported")
            special = {t["content"]: t["id"] for t in tokens}
        with open(ranks, "rb") as f:
            own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=own, special_tokens=special)
        _ENCODINGS[ranks, added] = lambda text: e.encode_to_numpy(text, allowed_special="all")
    return _ENCODINGS[ranks, added]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-shift hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


class ByteWords:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts at once, as positions in one buffer, with 64-bit hashes of the words' bytes.

    doc[i] is the row of word i; start/end are offsets in buf. hash() is a polynomial over 8-byte blocks, by prefix sums modulo 2^64.
    """

    _pow: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)  # bytes.lower() changes A-Z only
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lens)])
        white = WHITE[self.buf]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if len(self.buf) and not white[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1

    def hash(self) -> np.ndarray:
        n = len(self.buf)
        if len(ByteWords._pow) < n + 1:
            p = np.full(n + 1, 0x9E3779B97F4A7C15 | 1, np.uint64)
            p[0] = 1
            ByteWords._pow = np.cumprod(p, dtype=np.uint64)
        # sum of (byte+1) * r^(i) over the word, divided by r^start: r is odd, so r^-1 exists mod 2^64
        if not n:
            return np.zeros(0, np.uint64)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix(np.arange(256, dtype=np.uint64) + np.uint64(77)))[self.buf] * ByteWords._pow[:n], dtype=np.uint64)])
        inv = _inverse_powers(n)
        h = (s[self.end] - s[self.start]) * inv[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))


_INV = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INV
    if len(_INV) < n + 1:
        r = 0x9E3779B97F4A7C15 | 1
        p = np.full(n + 1, pow(r, -1, 1 << 64), np.uint64)
        p[0] = 1
        _INV = np.cumprod(p, dtype=np.uint64)
    return _INV


def crc32_mod5(doc_id="doc_id"):
    """crc32(doc_id as text) mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5
