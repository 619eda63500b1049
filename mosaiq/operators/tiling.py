"""From points to tiles: grid filter, resolution, merged counts, Voronoi cells and their pixels."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .spatial import knn_join

JOIN = "_et_"


def split_barcodes(cells: DataFrame) -> DataFrame:
    """cell, member: the barcodes that a merged one holds."""
    return cells.select(F.col("barcode").alias("cell"), F.explode(F.split("barcode", JOIN)).alias("member")).where("member <> ''")


def shared_barcodes(cells: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides less barcodes that the other lacks; an error if none is shared."""
    have = counts.select(F.col("barcode").alias("member")).distinct()
    kept = split_barcodes(cells).join(have, "member", "left_semi")
    if kept.isEmpty():
        raise ValueError("coordinates and counts share no barcode")
    return cells.join(kept.select(F.col("cell").alias("barcode")).distinct(), "barcode", "left_semi"), counts.join(kept.select(F.col("member").alias("barcode")).distinct(), "barcode", "left_semi")


def filter_grid(cells: DataFrame, f: float) -> DataFrame:
    """Without the cells of grid squares (coordinates times f, rounded half to even) whose count is at
    most the 1 % quantile of counts; f of 1 keeps all."""
    if not 0 < f <= 1:
        raise ValueError("filter_grid is above 0 and at most 1")
    if f == 1:
        return cells
    key = [F.rint(F.col("x") * f).alias("gx"), F.rint(F.col("y") * f).alias("gy")]
    sizes = cells.groupBy(*key).agg(F.count("*").alias("n"))
    few = sizes.crossJoin(F.broadcast(sizes.agg(F.percentile("n", 0.01).alias("q")))).where("n <= q").select("gx", "gy")
    return cells.withColumns({"gx": key[0], "gy": key[1]}).join(few, ["gx", "gy"], "left_anti").drop("gx", "gy")


def reduce_resolution(cells: DataFrame, r: float) -> DataFrame:
    """Coordinates times r, rounded half to even, plus 1. Cells that meet become one: their barcodes in
    order, each followed by _et_; the first one's original coordinates stay."""
    if not 0 < r <= 1:
        raise ValueError("tensor_resolution is above 0 and at most 1")
    if r == 1:
        return cells
    at = cells.withColumns({"px": F.rint(F.col("x") * r) + 1, "py": F.rint(F.col("y") * r) + 1})
    out = at.groupBy("px", "py").agg(F.array_sort(F.collect_list("barcode")).alias("m"))
    return out.select(F.when(F.size("m") > 1, F.concat(F.array_join("m", JOIN), F.lit(JOIN))).otherwise(F.col("m")[0]).alias("barcode"), F.col("px").alias("x"), F.col("py").alias("y"), F.size("m").alias("members"))


def check_resolution(before: int, after: int) -> None:
    if after < 2:
        raise ValueError("the resolution leaves a single position")
    if after < 0.1 * before:
        warnings.warn("the resolution leaves fewer than 10 % of the positions", stacklevel=2)


def adjust_counts(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts by (merged) cell: the mean over its members, absent ones as 0."""
    m = split_barcodes(cells)
    m = m.withColumn("n", F.count("*").over(W.partitionBy("cell")))
    return counts.join(m, F.col("barcode") == F.col("member")).groupBy("feature", F.col("cell").alias("barcode")).agg((F.sum("value") / F.first("n")).alias("value"))


def voronoi(cells: DataFrame, k: int = 24) -> DataFrame:
    """barcode, x, y, poly (vertices in angular order), area, neighbors: each cell's region within the
    bounding box widened by a tenth, cut by the bisectors of its nearest cells. k of them are enough if the
    last is twice as far as the region's farthest vertex; the cells for which it is not take four times as
    many, until all are sure."""
    box = cells.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.count("*").alias("n")).first()
    if not box["n"]:
        return _regions(cells, cells, 1, []).drop("reach", "last")
    wx, wy = max(1.0, (box["b"] - box["a"]) / 10), max(1.0, (box["d"] - box["c"]) / 10)
    frame = [(box["a"] - wx, box["c"] - wy), (box["b"] + wx, box["c"] - wy), (box["b"] + wx, box["d"] + wy), (box["a"] - wx, box["d"] + wy)]
    found, todo = None, cells
    while True:
        k = min(k, box["n"] - 1)
        out = cut(_regions(todo, cells, k, frame))
        sure = F.lit(True) if k == box["n"] - 1 else F.col("reach") <= F.col("last")
        found = out.where(sure) if found is None else found.union(out.where(sure))
        todo = out.where(~sure).select("barcode", "x", "y")
        if k == box["n"] - 1 or todo.isEmpty():
            return found.drop("reach", "last")
        k *= 4


def _regions(some: DataFrame, cells: DataFrame, k: int, frame: list[tuple[float, float]]) -> DataFrame:
    """voronoi's columns for some cells by k others, with reach (twice the distance of the farthest vertex)
    and last (the distance of the k-th other)."""
    at = cells.select(F.col("barcode").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    near = knn_join(some, cells, k + 1).where("center <> neighbor").join(at, "neighbor").groupBy(F.col("center").alias("barcode")).agg(F.collect_list(F.struct("dist", "neighbor", "nx", "ny")).alias("near"))

    def cut_polygon(frames):
        for f in frames:
            polys, areas, kept, reach, last = [], [], [], [], []
            for x, y, near_ in zip(f["x"], f["y"], f["near"], strict=True):
                poly, of = list(frame), [None] * 4
                for n in sorted(near_ if near_ is not None else [], key=lambda n: n["dist"]):
                    a, b = n["nx"] - x, n["ny"] - y
                    c = (n["nx"] ** 2 + n["ny"] ** 2 - x * x - y * y) / 2
                    if a == b == 0:
                        continue
                    side = [a * p + b * q - c for p, q in poly]
                    if max(side) <= 1e-9:
                        continue
                    new, new_of = [], []
                    for i, (p, q) in enumerate(poly):
                        j = (i + 1) % len(poly)
                        if side[i] <= 0:
                            new.append((p, q))
                            new_of.append(of[i])
                        if (side[i] <= 0) != (side[j] <= 0):
                            t = side[i] / (side[i] - side[j])
                            new.append((p + t * (poly[j][0] - p), q + t * (poly[j][1] - q)))
                            new_of.append(n["neighbor"] if side[i] <= 0 else of[i])
                    poly, of = new, new_of
                polys.append([{"x": p, "y": q} for p, q in poly])
                areas.append(abs(sum(poly[i][0] * poly[(i + 1) % len(poly)][1] - poly[(i + 1) % len(poly)][0] * poly[i][1] for i in range(len(poly)))) / 2 if poly else 0.0)
                kept.append(sorted({o for o in of if o is not None}))
                reach.append(2 * max((math.hypot(p - x, q - y) for p, q in poly), default=0.0))
                last.append(max((n["dist"] for n in near_), default=0.0) if near_ is not None else 0.0)
            yield f[["barcode", "x", "y"]].assign(poly=polys, area=areas, neighbors=kept, reach=reach, last=last)

    return some.select("barcode", "x", "y").join(near, "barcode", "left").mapInPandas(cut_polygon, "barcode string, x double, y double, poly array<struct<x:double,y:double>>, area double, neighbors array<string>, reach double, last double")


def filter_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """Without tiles of an area at or above the quantile `threshold`, nor among others' neighbours; 1 keeps all."""
    if threshold == 1:
        return tiles
    kept = tiles.crossJoin(F.broadcast(tiles.agg(F.percentile("area", threshold).alias("q")))).where("area < q").drop("q")
    if "neighbors" not in tiles.columns:
        return kept
    edges = kept.select("barcode", F.explode("neighbors").alias("n")).join(kept.select(F.col("barcode").alias("n")), "n", "left_semi").groupBy("barcode").agg(F.array_sort(F.collect_list("n")).alias("__n"))
    return kept.join(edges, "barcode", "left").withColumn("neighbors", F.coalesce("__n", F.array().cast("array<string>"))).select(*tiles.columns)


def rasterise(tiles: DataFrame) -> DataFrame:
    """barcode, x, y, origin: the pixels inside or on each region's polygon (vertices rounded up), origin 1
    at the rounded centre or else the middle pixel."""

    def pixels(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for b, cx, cy, poly in zip(f["barcode"], f["x"], f["y"], f["poly"], strict=True):
                v = np.ceil(np.array([(p["x"], p["y"]) for p in poly])) if len(poly) else np.zeros((0, 2))
                if not len(v):
                    continue
                lo, hi = np.maximum(v.min(axis=0) - 1, 1).astype(int), (v.max(axis=0) + 1).astype(int)
                gx, gy = (g.ravel() for g in np.meshgrid(np.arange(lo[0], hi[0] + 1), np.arange(lo[1], hi[1] + 1), indexing="ij"))
                w = np.roll(v, -1, axis=0)
                cross = (w[:, 0] - v[:, 0]) * (gy[:, None] - v[:, 1]) - (w[:, 1] - v[:, 1]) * (gx[:, None] - v[:, 0])
                inside = (cross >= 0).all(axis=1) | (cross <= 0).all(axis=1)
                inside &= (gx >= v[:, 0].min()) & (gx <= v[:, 0].max()) & (gy >= v[:, 1].min()) & (gy <= v[:, 1].max())
                gx, gy = gx[inside], gy[inside]
                if not len(gx):
                    gx, gy = np.array([max(1, round(cx))]), np.array([max(1, round(cy))])
                origin = ((gx == round(cx)) & (gy == round(cy))).astype(int)
                if not origin.any():
                    origin[len(origin) // 2] = 1
                yield pd.DataFrame({"barcode": b, "x": gx, "y": gy, "origin": origin})

    return tiles.select("barcode", "x", "y", "poly").mapInPandas(pixels, "barcode string, x int, y int, origin int")


def generate_tiles(cells: DataFrame, tensor_resolution: float = 1, filter_grid_at: float = 0.01, filter_threshold: float = 0.995) -> DataFrame:
    """Grid filter, resolution, Voronoi regions, area filter and pixels in turn."""
    kept = filter_grid(cells, filter_grid_at)
    reduced = reduce_resolution(kept, tensor_resolution)
    if tensor_resolution < 1:
        check_resolution(kept.select("x", "y").distinct().count(), reduced.count())
    return rasterise(filter_tiles(voronoi(reduced), filter_threshold))
