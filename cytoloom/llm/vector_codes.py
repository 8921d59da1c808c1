"""Operator 11. Vector code compression: product codes whose entries stand in a vantage-point tree for each part position.

Components become integers, floor(4096 x), and a vector is cut into equal parts. Each round finds the nearest codebook entry of every part, by
branch and bound in the tree of its position: a subtree is left only if the least possible distance, from radii and distances rounded outward to
integers, is greater than the best one found; equal ones are visited, and distances compared are squared integers. Tasks add their parts up entry
by entry, so a round shuffles at most entries x dimension rows a task, and the driver gets one number for each component of the codebooks.

Rows whose vector is null, or has null or non-finite components (2^127 and more in absolute value counts as such), go. The dimension is that of
the least vec_id (null last, then the vector) whose length is a positive multiple of the number of parts; rows of other lengths go as well. Fewer
rows than entries give fewer entries. Repeated vec_ids are rows of their own and start the codebook in the order of their vectors; a null vec_id
and null labels stay (null labels are one label). Equal distances go to the lower index. Errors beyond 64 bits are null. An empty table gives
no rows. Extra columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table, trim

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of a block: vectors that a worker handles at once.
BLOCK = 1 << 20
#: Squared distances stay below 2^62 if components are below this; larger ones are computed with Python's integers.
SAFE = 1 << 28
#: Points of a leaf.
LEAF = 2
#: Sums travel as limbs of so many bits, so that adding up can't overflow.
LIMB, LIMBS = 40, 5
#: Labels that more than one row in so many has are looked up by broadcast (there are at most so many of them); all others by a join.
HOT = 1000


def _isqrt(x: np.ndarray) -> np.ndarray:
    """Floor of the square root, exactly."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) for v in x], object)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = rows - point
    return (d * d).sum(axis=1)


@dataclass
class Node:
    """A vantage point (an entry's index) with its inner and outer subtree and the least and greatest distance in each, rounded outward; or a leaf of entries."""

    entries: list[int]
    sides: list[tuple[int, int, Node]]


def grow(book: np.ndarray, entries: list[int]) -> Node:
    """The tree over entries of a codebook: the lowest index is the vantage point, the nearer half of the others goes inside."""
    if len(entries) <= LEAF:
        return Node(entries, [])
    top, rest = entries[0], entries[1:]
    d = _distance(book[rest], book[top])
    order = sorted(range(len(rest)), key=lambda i: (d[i], rest[i]))
    sides = []
    for half in (order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :]):
        if half:
            low, high = math.isqrt(int(d[half[0]])), math.isqrt(int(d[half[-1]]))
            sides.append((low, high + (high * high < d[half[-1]]), grow(book, sorted(rest[i] for i in half))))
    return Node([top], sides)


def nearest(tree: Node, book: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lower one of equal) and the squared distance; all rows walk the tree together, each its own way."""
    best = np.full(len(rows), -1, rows.dtype)
    index = np.full(len(rows), len(book), np.int64)

    def look(node: Node, of: np.ndarray) -> None:
        for e in node.entries:
            d = _distance(rows[of], book[e])
            better = (best[of] < 0) | (d < best[of]) | ((d == best[of]) & (e < index[of]))
            best[of[better]], index[of[better]] = d[better], e
        if not node.sides or not len(of):
            return
        low = _isqrt(d)
        high = low + (low * low < d)
        bound = [np.maximum(np.maximum(a - high, low - b), 0) for a, b, _ in node.sides]
        first = np.zeros(len(of), bool) if len(bound) == 1 else bound[1] < bound[0]  # the side that may be nearer comes first

        def visit(side: int, which: np.ndarray) -> None:
            near = bound[side][which]
            go = near * near <= best[of[which]]
            if go.any():
                look(node.sides[side][2], of[which[go]])

        a, b = np.flatnonzero(~first), np.flatnonzero(first)
        for side, which in ((0, a), (1, b), (1, a), (0, b)):
            if side < len(bound) and len(which):
                visit(side, which)

    look(tree, np.arange(len(rows)))
    return index, best


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of finite doubles: 64-bit if squared distances fit, else Python's integers."""
    if not len(values) or np.abs(values).max() < SAFE / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([math.floor(x * SCALE) for x in values.tolist()], object)


@dataclass
class Codebooks:
    """books[p]: the entries of part position p, one row an entry."""

    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for x in b.reshape(-1)).encode()).hexdigest()

    def trees(self) -> list[tuple[Node, np.ndarray]]:
        return [(grow(b, list(range(len(b)))), b) for b in self.books]


def _fits(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and entries as one type of number."""
    if rows.dtype == object or book.dtype == object:
        return rows.astype(object), book.astype(object)
    return rows, book


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            yield b, whole_numbers(b.column(column).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, dim)
    trim()


def _assign(q: np.ndarray, trees: list[tuple[Node, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position the rows' parts, entries and squared distances."""
    width = q.shape[1] // len(trees)
    for p, (tree, book) in enumerate(trees):
        rows, own = _fits(q[:, p * width : (p + 1) * width], book)
        yield rows, *nearest(tree, own, rows)


def kept(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, v as doubles, label) of rows that can be coded, written to the shared folder, and the dimension (0: there are none)."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    fine = v.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**127)))
    fine = materialise(fine, "vectors")
    first = fine.where((F.size("v") > 0) & (F.size("v") % parts == 0)).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    return fine.where(F.size("v") == dim) if dim else fine.limit(0), dim


def start(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the least vec_ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    q = whole_numbers(np.array([x for r in rows for x in r.v])).reshape(len(rows), dim)
    return Codebooks([q[:, p * dim // parts : (p + 1) * dim // parts] for p in range(parts)])


def _limbs(x: int) -> list[int]:
    return [x >> LIMB * i & (1 << LIMB) - 1 for i in range(LIMBS - 1)] + [x >> LIMB * (LIMBS - 1)]


def refine(vectors: DataFrame, dim: int, codebooks: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts."""
    trees = codebooks.trees()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, object) for _, b in trees]
        count = [np.zeros(len(b), np.int64) for _, b in trees]
        for _, q in _blocks(batches, dim, 0):
            for p, (rows, index, _) in enumerate(_assign(q, trees)):
                for e in np.unique(index):
                    own = rows[index == e]
                    total[p][e] += own.sum(axis=0).astype(object)
                    count[p][e] += len(own)
        out = [(p, int(e), k, int(count[p][e]), *_limbs(int(total[p][e][k]))) for p in range(len(trees)) for e in np.flatnonzero(count[p]) for k in range(total[p].shape[1])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 3 + [pa.int64()] * (1 + LIMBS), strict=True)], names)

    names = ["part", "entry", "k", "n", *(f"l{i}" for i in range(LIMBS))]
    sums = vectors.select("v").mapInArrow(run, ", ".join(f"{c} int" for c in names[:3]) + ", " + ", ".join(f"{c} long" for c in names[3:]))
    books = [b.astype(object) for b in codebooks.books]
    for r in sums.groupBy("part", "entry", "k").agg(*(F.sum(c).alias(c) for c in names[3:])).collect():  # one row for each component of the codebooks
        books[r.part][r.entry, r.k] = sum(r[f"l{i}"] << LIMB * i for i in range(LIMBS)) // r.n
    small = all(abs(int(x)) < SAFE for b in books for x in b.reshape(-1))
    return Codebooks([b.astype(np.int64) if small else b for b in books])


def codes(vectors: DataFrame, dim: int, codebooks: Codebooks) -> DataFrame:
    """(vec_id, label, code, error): entries' indexes in two hex digits each, in order of parts; squared distances summed over parts."""
    trees = codebooks.trees()
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, q in _blocks(batches, dim, 1):
            code, error = np.full(len(q), "", object), np.zeros(len(q), object)
            for _, index, d in _assign(q, trees):
                code, error = code + hexes[index].astype(object), error + d
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(code, pa.string()), pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "v", "label").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of a label's rows summed up; labels that many rows share meet no join of theirs."""
    sums = coded.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.max(F.col("error").isNull()).alias("beyond"))
    sums = materialise(sums.select("label", "rows", F.when(~F.col("beyond"), F.col("s").try_cast("long")).alias("label_error")), "label-errors")
    total = sums.agg(F.sum("rows")).first()[0] or 0
    own = coded.withColumnRenamed("label", "own")
    common = F.broadcast(sums.where(F.col("rows") * HOT > total))
    same = F.col("own").eqNullSafe(F.col("label"))
    rare = own.join(common, same, "left_anti").join(sums.where(F.col("rows") * HOT <= total), same)
    return own.join(common, same).unionByName(rare).drop("label", "rows").withColumnRenamed("own", "label")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of a table (vec_id, embedding, label). At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    rows, dim = kept(vectors, parts)
    if dim:
        books = start(rows, dim, parts, entries)
        for _ in range(rounds):
            books = refine(rows, dim, books)
        coded, digest = materialise(codes(rows, dim, books), "codes"), books.digest()
    else:
        coded, digest = rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error"), ""
    return with_label_errors(coded).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after the other, every part against every entry; for vectors of one length and components whose squares fit."""
    sql = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"piece AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(q) // {parts}) AS part, (i - 1) % (len(q) // {parts}) AS k, q[i] AS x FROM (SELECT vec_id, q, unnest(range(1, len(q) + 1)) AS i FROM kept))",
        f"book0 AS MATERIALIZED (SELECT part, entry, k, x FROM piece JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        sql.append(f"near{r} AS MATERIALIZED (SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, part, entry, sum((p.x - b.x) ** 2)::HUGEINT AS d FROM piece p JOIN book{r} b USING (part, k) GROUP BY ALL) GROUP BY ALL)")
        if r < rounds:
            sql.append(f"mean{r} AS MATERIALIZED (SELECT part, entry, k, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT part, entry, k, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM piece JOIN near{r} USING (vec_id, part) GROUP BY ALL))")
            sql.append(f"book{r + 1} AS MATERIALIZED (SELECT part, entry, k, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (part, entry, k))")
    sql.append(f"coded AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} JOIN kept USING (vec_id) GROUP BY ALL)")
    return "WITH " + ", ".join(sql) + f" SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, k)) FROM book{rounds}) AS codebooks_sha256 FROM coded"
