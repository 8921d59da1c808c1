"""Which labels lie next to each other more often than by chance: O140.

A shuffle of a sample's labels is a keyed bijection of its cells' numbers: cell i gets the label that stands at place f(i) when labels are laid out in
order. So an edge's shuffled labels follow from its two numbers, the sample's label counts and the shuffle's key, and edges are counted in the tiles
that find them, over all shuffles: no edge is a row, and what is shuffled after that is a line of counts a sample and label. Tiles of a sample of up to
DRAWN cells lie in one partition, so that its shuffles are drawn about once; no larger sample's cells are gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import normal_p
from ..plans.registry import query
from .tiles import _blocks, _near, _once, _tiled

#: Edges that are held before they are counted, at least; counts that are held at once, at most (one sample's always).
EDGES, COUNTS = 1_000_000, 4_000_000
#: Cells of a sample whose shuffles are drawn as whole permutations.
DRAWN = 1 << 16
# Labels that count as tumour, and labels of which no pair is reported.
TUMOUR, NAMELESS = ["tumor", "tumour", "cancer", "panck+"], ["unknown", "other"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffled(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 to n-1. Up to DRAWN numbers a drawn permutation; beyond, six Feistel rounds over the least even number of bits that holds n, through which what falls outside goes again: nothing of the sample's size is kept."""
    if n <= DRAWN:
        return np.random.default_rng(key).permutation(n)[i]
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(6):
            left, right = right, left ^ (_mix(right + np.uint64((key + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64))) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _counting(group: T.StructField, n_perm: int, seed: int):
    """For mapInArrow over tiles: (group, a, counts): of edges from label number a, how many lead to each label, as seen and in each shuffle in turn; a sample may have several such rows."""
    schema = T.StructType([group, T.StructField("a", T.IntegerType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def count(t: pa.Table, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = t.column(group.name).combine_chunks()
        g = (g.chunk(0) if isinstance(g, pa.ChunkedArray) else g).dictionary_encode("encode")
        of, cell, code = g.indices.to_numpy(zero_copy_only=False), t.column("cell").to_numpy(), t.column("code").to_numpy()
        o = np.argsort(of[i], kind="stable")
        i, j = i[o], j[o]
        there, start = np.unique(of[i], return_index=True)  # samples with edges
        start = np.append(start, len(i))
        by_sample = np.argsort(of, kind="stable")
        edge = np.searchsorted(of[by_sample], np.stack([there, there + 1]))
        sizes = [np.array(x) for x in t.column("n").take(pa.array(by_sample[edge[0]])).to_pylist()]
        k = max(map(len, sizes), default=0)
        own = [zlib.crc32(str(x).encode()) for x in g.dictionary.take(pa.array(there)).to_pylist()]
        place = np.zeros(len(of), np.int64)
        place[by_sample] = np.searchsorted(there, of[by_sample])
        some = max(1, COUNTS // max(1, (n_perm + 1) * k * k))
        lab = np.zeros(len(of), np.int64)
        for lo in range(0, len(there), some):
            hi = min(lo + some, len(there))
            u, v = i[start[lo] : start[hi]], j[start[lo] : start[hi]]
            at = (place[u] - lo) * k * k
            table = np.zeros((n_perm + 1, (hi - lo) * k * k), np.int64)
            table[0] = np.bincount(at + code[u] * k + code[v], minlength=table.shape[1])
            rows = [by_sample[edge[0, q] : edge[1, q]] for q in range(lo, hi)]
            cells, bounds = [cell[x] for x in rows], [np.cumsum(sizes[q]) for q in range(lo, hi)]
            for p in range(n_perm):
                for q, x, y, b in zip(range(lo, hi), rows, cells, bounds, strict=True):
                    lab[x] = np.searchsorted(b, shuffled(y, int(b[-1]), (seed << 48) ^ (p << 32) ^ own[q]), "right")
                table[p + 1] = np.bincount(at + lab[u] * k + lab[v], minlength=table.shape[1])
            table = table.reshape(n_perm + 1, hi - lo, k, k)
            table = table + table.swapaxes(2, 3)  # an edge leads both ways
            many = np.array([len(sizes[q]) for q in range(lo, hi)])
            values = np.concatenate([table[:, q, :m, :m].swapaxes(0, 1).ravel() for q, m in enumerate(many)])
            offsets = np.concatenate([[0], np.cumsum(np.repeat(many * (n_perm + 1), many))])
            out = [g.dictionary.take(pa.array(np.repeat(there[lo:hi], many))), pa.array(np.concatenate([np.arange(m) for m in many])), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))]
            yield from pa.Table.from_arrays([x.cast(f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow).to_batches(max_chunksize=1_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches):
            held, n = [], 0
            for pair in _once(t, _near(t)):
                held.append(pair)
                n += len(pair[0])
                if n >= EDGES:
                    yield from count(t, *map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
            if n:
                yield from count(t, *map(np.concatenate, zip(*held, strict=True)))

    return run, schema


def _comparing(group: T.StructField, n_perm: int):
    """For mapInArrow over rows of `_counting` in order: (group, a, b, observed, mean, sd) of the shares of label b among the edges from label a."""
    schema = T.StructType([group, *(T.StructField(x, T.IntegerType()) for x in "ab"), *(T.StructField(x, T.DoubleType()) for x in ("observed", "mean", "sd"))])
    arrow = to_arrow_schema(schema)

    def compared(counts: np.ndarray) -> tuple[np.ndarray, ...]:
        n = counts.reshape(n_perm + 1, -1)
        share = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
        seen, by_chance = share[0], share[1:]
        none = np.full(len(seen), np.nan)
        spread = by_chance.std(axis=0, ddof=1) * (by_chance.max(axis=0) > by_chance.min(axis=0)) if n_perm > 1 else none
        return seen, by_chance.mean(axis=0) if n_perm else none, spread

    def batch(keys: list, found: list) -> pa.RecordBatch:
        many = [len(x[0]) for x in found]
        out = [pa.array([k[0] for k in keys], arrow.field(0).type).take(pa.array(np.repeat(np.arange(len(keys)), many)))]
        out += [pa.array(np.repeat([k[1] for k in keys], many), pa.int32()), pa.array(np.concatenate([np.arange(m) for m in many]), pa.int32())]
        return pa.RecordBatch.from_arrays([*out, *(pa.array(np.concatenate(x), from_pandas=True) for x in zip(*found, strict=True))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for b in batches:
            keys, found = [], []
            flat, ends = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            for k, lo, hi in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), ends[:-1], ends[1:], strict=True):
                if k == key:
                    held = held + flat[lo:hi]
                    continue
                if key is not None:
                    keys.append(key)
                    found.append(compared(held))
                key, held = k, flat[lo:hi]
            held = held if held is None else held.copy()
            if keys:
                yield batch(keys, found)
        if key is not None:
            yield batch([key], [compared(held)])

    return run, schema


def permutation_scores(cells: DataFrame, r: float, n_perm: int = 50, seed: int = 1, group: str = "sample_id", min_labels: int = 2, min_cells: int = 3, pairs_mode: str = "both") -> DataFrame:
    """O140: (group, pa, pb, observed, diff, z, p): the share of label pb among the neighbours within r of cells of label pa, less its mean over shuffled labels, the same in standard deviations, and the two-sided normal p of that (null without spread).

    Left out are groups without edges or with fewer than min_labels labels of at least min_cells cells. pairs_mode: `both`, `immune_only` (no
    tumour label in the pair) or `tumor_only` (one at least); pairs of unknown and other cells are never given, but count in the shares. Cells
    without a label or place are left out; cell ids are unique in a group.
    """
    if pairs_mode not in ("both", "immune_only", "tumor_only"):
        raise ValueError("pairs_mode: both, immune_only or tumor_only")
    c = cells.where("phenotype IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    numbered = c.select(group, "x", "y", "phenotype", (F.row_number().over(Window.partitionBy(group).orderBy("cell_id")) - 1).cast("long").alias("cell"))
    counts = c.groupBy(group, "phenotype").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("phenotype", "n"))).alias("labels"), F.count_if(F.col("n") >= min_cells).alias("fit")).where(F.col("fit") >= min_labels).drop("fit")
    code = (F.array_position(F.col("labels.phenotype"), F.col("phenotype")) - 1).cast("int").alias("code")
    points = numbered.join(labels, group).select(group, "x", "y", "cell", code, F.col("labels.n").alias("n"))
    size = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    kind = c.schema[group]
    counted = _tiled(points, [group], F.lit(float(r)), whole=size <= DRAWN).mapInArrow(*_counting(kind, n_perm, seed))
    shares = counted.repartition(group, "a").sortWithinPartitions(group, "a").mapInArrow(*_comparing(kind, n_perm))
    s = shares.join(labels, group).select(group, F.expr("labels[a].phenotype").alias("pa"), F.expr("labels[b].phenotype").alias("pb"), "observed", "mean", "sd")
    tumour = lambda x: F.lower(x).isin(TUMOUR)
    any_tumour = tumour("pa") | tumour("pb")
    s = s.where(~(F.lower("pa").isin(NAMELESS) | F.lower("pb").isin(NAMELESS)))
    s = {"both": s, "immune_only": s.where(~any_tumour), "tumor_only": s.where(any_tumour)}[pairs_mode]
    diff = F.col("observed") - F.col("mean")
    s = s.select(group, "pa", "pb", "observed", diff.alias("diff"), F.when(F.col("sd") > 0, diff / F.col("sd")).alias("z"))
    return s.withColumn("p", normal_p(F.col("z")))


@query("o140_interaction_permutations")
def _o140(t):
    return permutation_scores(t.cells(), 2.0)
