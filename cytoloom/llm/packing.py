"""Operator 1. Packing: concatenate and cut.

Pass 1 encodes each text once and writes ids with their offset in the partition. The partitions' totals (one number a task) are
summed up into global offsets. Pass 2 cuts fixed windows: a piece is a document's share of a window. Windows that lie in one task are
whole there; those that straddle tasks leave boundary records, the only rows that `sequences` shuffles.

Null text is empty, so such a document has its end id alone, as has an empty one; an empty table gives no rows; repeated rows and ids are
packed as they come, each with its own pieces; a null doc_id stays null. Texts of any length are encoded whole (a document is one row of ids,
so up to 2^30 tokens). Extra columns, whatever their names, are left out. Ids are kept in 16 bits, so a vocabulary has at most 65,536 ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import blocks, encoding, materialise, table

LENGTH, END_ID = 2048, 1
_TOKENS = "part int, start long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, end_id: int = END_ID, ranks: str | None = None, added: str | None = None) -> DataFrame:
    """Pass 1, written to the shared folder: (part, start in the part, doc_id, n, ids as little-endian unsigned 16-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoding(ranks, added), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for b in blocks(batches):
            ids = [enc(t or "").astype("<u2").tobytes() + end for t in b.column(1).to_pylist()]
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(first), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "start", "doc_id", "n", "ids"])

    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _TOKENS), "tokens")


def bases(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each part: a prefix sum over one total a task."""
    at, out = 0, {}
    for r in sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        out[r[0]] = at
        at += r[1]
    return out


def _cut(first: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    at = 0
    while at < n:
        seq, off = divmod(first + at, length)
        m = min(length - off, n - at)
        yield at, m, seq, off
        at += m


def pieces(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pass 2: one row per piece, with the CRC of its ids as unsigned 32-bit little-endian numbers."""
    base = tokens.sparkSession.sparkContext.broadcast(bases(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 4):
            out: list[tuple] = []
            for part, start, doc, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = np.frombuffer(ids, "<u2").astype("<u4")
                out += [(doc, at, m, zlib.crc32(a[at : at + m].tobytes()), n, seq, off) for at, m, seq, off in _cut(base.value[part] + start, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in _PIECES.split(", ")])

    return tokens.mapInArrow(run, _PIECES)


def sequences(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids as unsigned 32-bit). Only windows that straddle tasks are shuffled, at most `length` records for each."""
    base = tokens.sparkSession.sparkContext.broadcast(bases(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def rows(done: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["sequence_id", "offset", "ids"])

        for b in blocks(batches, 4):
            done = []
            for part, start, _, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = np.frombuffer(ids, "<u2").astype("<u4")
                for at, m, seq, off in _cut(base.value[part] + start, n, length):
                    held.setdefault(seq, []).append((off, a[at : at + m].tobytes()))
            for seq in [s for s, x in held.items() if sum(len(y) for _, y in x) == 4 * length]:
                done.append((seq, 0, b"".join(y for _, y in sorted(held.pop(seq)))))
            yield rows(done)
        yield rows([(s, off, y) for s, x in held.items() for off, y in x])

    parts = tokens.mapInArrow(run, "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 4 * length
    edge = parts.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    glue = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    return parts.where(whole).select("sequence_id", "ids").unionByName(edge.select("sequence_id", glue))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(encode(table(spark, sf_dir, "documents")))
