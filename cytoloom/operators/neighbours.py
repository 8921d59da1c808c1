"""Nearest cells of each label, with no sample gathered in a task: O056, O134.

Samples are cut into tiles of bounded mean size, and each tile is searched by itself. What a tile can't settle, since something nearer may lie beyond
its edge, is searched on by joins: each label of a sample has a grid with about one of its cells a square, and blocks of squares around an
unsettled cell grow until what was found is nearer than the block's edge, or the block holds the whole grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Mean number of cells of a tile.
TILE = 20_000


def nearest(q: np.ndarray, p: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distance of each q to the nearest p other than its own place in p (-1: none); infinite if there is none. Points lie in squares of about two; rings of squares are searched until none nearer can follow, and places far from all points are compared with each."""
    best = np.full(len(q), np.inf)
    if not len(p):
        return best
    low = p.min(axis=0)
    extent = np.maximum(p.max(axis=0) - low, 1e-9)
    side = max(np.sqrt(extent.prod() * 2 / len(p)), extent.max() / 1e6)
    cell = np.floor((p - low) / side).astype(np.int64)
    rows = int(cell[:, 1].max()) + 1
    key = cell[:, 0] * rows + cell[:, 1]
    o = np.argsort(key, kind="stable")
    key, places = key[o], p[o]
    home = np.floor((q - low) / side).astype(np.int64)
    left = np.arange(len(q))
    for ring in range(9):
        for i in range(-ring, ring + 1):
            for j in range(-ring, ring + 1) if abs(i) == ring else (-ring, ring):
                at = home[left] + (i, j)
                ok = np.flatnonzero((at[:, 0] >= 0) & (at[:, 1] >= 0) & (at[:, 1] < rows))
                k = at[ok, 0] * rows + at[ok, 1]
                lo, hi, who = np.searchsorted(key, k), np.searchsorted(key, k, "right"), left[ok]
                while len(who):  # the next point of each square
                    some = lo < hi
                    lo, hi, who = lo[some], hi[some], who[some]
                    d = ((q[who] - places[lo]) ** 2).sum(axis=1)
                    d[o[lo] == own[who]] = np.inf
                    best[who] = np.minimum(best[who], d)
                    lo = lo + 1
        left = left[best[left] > (ring * side) ** 2]
        if not len(left):
            break
    for i in range(0, len(left), 256):
        some = left[i : i + 256]
        d = ((q[some, None] - p[None]) ** 2).sum(axis=2)
        d[own[some, None] == np.arange(len(p))[None]] = np.inf
        best[some] = d.min(axis=1)
    return best


def _search_tile(group: str, columns: list[str]):
    """A tile's cells against each other: distances squared, and whether nothing beyond the tile can be nearer. key: group, tile, the tile's edges, the sample's labels (none: there is one tile)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, x1, y0, y1, labels = key[3:]
        xy, lab = pdf[["x", "y"]].to_numpy(float), pdf["phenotype"].to_numpy()
        edge = np.minimum(np.minimum(xy[:, 0] - x0, x1 - xy[:, 0]), np.minimum(xy[:, 1] - y0, y1 - xy[:, 1]))
        out = []
        for to in sorted({*lab, *labels}):
            at = np.flatnonzero(lab == to)
            own = np.full(len(xy), -1)
            own[at] = np.arange(len(at))
            d2 = nearest(xy, xy[at], own)
            sure = (edge > 0) & (d2 <= edge * edge * (1 - 1e-9)) if len(labels) else np.ones(len(xy), bool)
            ok = np.isfinite(d2) | ~sure
            out.append(pd.DataFrame({group: pdf[group].to_numpy()[ok], "cell_id": pdf["cell_id"].to_numpy()[ok], "x": xy[ok, 0], "y": xy[ok, 1], "pa": lab[ok], "pb": to, "d2": d2[ok], "sure": sure[ok]}))
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns)

    return run


def _search_whole(group: str):
    """A whole group's cells against each other: labels and distances squared, a row for each cell and label that has another cell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy(float)
        names, code = np.unique(pdf["phenotype"].to_numpy(str), return_inverse=True)
        pa, pb, out = [], [], []
        for to in range(len(names)):
            at = np.flatnonzero(code == to)
            own = np.full(len(xy), -1)
            own[at] = np.arange(len(at))
            d2 = nearest(xy, xy[at], own)
            ok = np.isfinite(d2)
            pa, pb, out = [*pa, code[ok]], [*pb, np.full(int(ok.sum()), to)], [*out, d2[ok]]
        return pd.DataFrame({group: key[0], "pa": names[np.concatenate(pa)], "pb": names[np.concatenate(pb)], "d2": np.concatenate(out)})

    return run


def _ring(at: str, low: int, high: int) -> Column:
    """Squares around a square (`at`x, `at`y), further than `low` and no further than `high`, inside the label's grid."""
    span = lambda c, n: F.sequence(F.greatest(F.col(f"{at}{c}") - high, F.lit(0)), F.least(F.col(f"{at}{c}") + high, F.col(n)))
    squares = F.flatten(F.transform(span("x", "nx"), lambda i: F.transform(span("y", "ny"), lambda j: F.struct(i.alias("sx"), j.alias("sy")))))
    return F.filter(squares, lambda s: F.greatest(F.abs(s["sx"] - F.col(f"{at}x")), F.abs(s["sy"] - F.col(f"{at}y"))) > low)


def nearest_distances(cells: DataFrame, group: str = "sample_id", tile: int = TILE) -> DataFrame:
    """O056, O134: (group, pa, pb, distance) from each cell to the nearest other cell of each label of its group; labels without another cell are left out.

    cells: (group, cell_id, x, y, phenotype), ids unique in a group; rows without place or label are left out. Cells at one place are at distance 0.
    Groups up to `tile` cells are one tile. Memory of a task follows the fullest tile, and rows of a join the cells of a label in one square of
    its grid.
    """
    kind = dict(cells.dtypes)
    c = cells.select(group, "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "phenotype").where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND phenotype IS NOT NULL")
    n = F.count(F.lit(1)).alias("n")
    box = c.groupBy(group).agg(n, F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sort_array(F.collect_set("phenotype")).alias("labels"))
    columns = [group, "cell_id", "x", "y", "pa", "pb", "d2", "sure"]
    schema = f"{group} {kind[group]}, cell_id {kind['cell_id']}, x double, y double, pa string, pb string, d2 double, sure boolean"
    most = c.groupBy(group).agg(n).agg(F.max("n")).first()[0] or 0
    if most <= tile:  # every group is one tile
        found = c.select(group, "x", "y", "phenotype").groupBy(group).applyInPandas(_search_whole(group), f"{group} {kind[group]}, pa string, pb string, d2 double")
        return found.select(group, "pa", "pb", F.sqrt("d2").alias("distance"))
    k = F.ceil(F.sqrt(F.col("n") / tile)).cast("int")
    cut = box.select(group, k.alias("k"), "x0", "y0", F.greatest((F.col("x1") - F.col("x0")) / k, F.lit(1e-9)).alias("w"), F.greatest((F.col("y1") - F.col("y0")) / k, F.lit(1e-9)).alias("h"), F.when(k > 1, F.col("labels")).otherwise(F.array().cast("array<string>")).alias("labels"))
    at = lambda v, o, s: F.least(F.floor((F.col(v) - F.col(o)) / F.col(s)), F.col("k") - 1)
    tiled = c.join(cut, group).withColumn("ix", at("x", "x0", "w")).withColumn("iy", at("y", "y0", "h"))
    # a tile at the border of its sample ends there: nothing lies beyond
    far = F.lit(1e300)
    side = lambda i, o, s: (F.when(F.col(i) == 0, -far).otherwise(F.col(o) + F.col(i) * F.col(s)), F.when(F.col(i) == F.col("k") - 1, far).otherwise(F.col(o) + (F.col(i) + 1) * F.col(s)))
    (a, b), (e, d) = side("ix", "x0", "w"), side("iy", "y0", "h")
    tiled = tiled.select(group, "ix", "iy", a.alias("a"), b.alias("b"), e.alias("c"), d.alias("d"), "labels", "cell_id", "x", "y", "phenotype")
    found = kept(tiled.groupBy(group, "ix", "iy", "a", "b", "c", "d", "labels").applyInPandas(_search_tile(group, columns), schema), "tiles")
    grid = _grids(c.join(box.where(F.col("n") > tile).select(group), group, "left_semi"), box, group)
    settled = [found.where("sure AND d2 < double('infinity')").select(group, "pa", "pb", "d2")]
    targets = c.withColumnRenamed("phenotype", "pb").join(grid, [group, "pb"])
    square = lambda v, o: F.floor((F.col(v) - F.col(o)) / F.col("side"))
    targets = targets.select(group, "pb", square("x", "x0").alias("sx"), square("y", "y0").alias("sy"), F.struct("cell_id", "x", "y").alias("t"))
    left = found.where("NOT sure").drop("sure").join(grid, [group, "pb"]).withColumn("hx", square("x", "x0")).withColumn("hy", square("y", "y0"))
    low, high = -1, 1
    while True:
        dx, dy = F.col("x") - F.col("t.x"), F.col("y") - F.col("t.y")
        asked = left.withColumn("s", F.explode(_ring("h", low, high))).withColumn("sx", F.col("s.sx")).withColumn("sy", F.col("s.sy")).drop("s")
        near = asked.join(targets, [group, "pb", "sx", "sy"]).where(F.col("cell_id") != F.col("t.cell_id")).groupBy(group, "cell_id", "pb").agg(F.min(dx * dx + dy * dy).alias("more"))
        out = left.join(near, [group, "cell_id", "pb"], "left").withColumn("d2", F.least("d2", F.coalesce("more", F.lit(float("inf"))))).drop("more")
        inner = lambda v, o, h: F.least(F.col(v) - F.col(o) - F.col(h) * F.col("side"), F.col(o) + (F.col(h) + 1) * F.col("side") - F.col(v))
        reach = (F.least(inner("x", "x0", "hx"), inner("y", "y0", "hy")) + high * F.col("side")) * (1 - 1e-9)
        covered = (F.col("hx") - high <= 0) & (F.col("hy") - high <= 0) & (F.col("hx") + high >= F.col("nx")) & (F.col("hy") + high >= F.col("ny"))
        out = kept(out.withColumn("sure", covered | ((reach > 0) & (F.col("d2") <= reach * reach))), "ring")
        settled.append(out.where("sure AND d2 < double('infinity')").select(group, "pa", "pb", "d2"))
        left = out.where("NOT sure").drop("sure")
        if left.isEmpty():
            break
        low, high = high, 2 * high + 1
    rows = settled[0]
    for s in settled[1:]:
        rows = rows.unionByName(s)
    return rows.select(group, "pa", "pb", F.sqrt("d2").alias("distance"))


def _grids(cells: DataFrame, box: DataFrame, group: str) -> DataFrame:
    """(group, pb, x0, y0, side, nx, ny): a grid of each label over the whole box of its group, with about one of its cells a square, 4,096 squares a side at most; nx and ny are the last squares."""
    n = cells.groupBy(group, F.col("phenotype").alias("pb")).agg(F.count(F.lit(1)).alias("m"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    side = F.greatest(F.sqrt(w * h / F.col("m")), w / 4096, h / 4096, F.lit(1e-9))
    g = n.join(box.select(group, "x0", "x1", "y0", "y1"), group).withColumn("side", side)
    return g.select(group, "pb", "x0", "y0", "side", F.floor(w / F.col("side")).alias("nx"), F.floor(h / F.col("side")).alias("ny"))
