"""Neighbour joins on points, bucketed by grid cells so that each becomes an equi-join, and graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .blocks import Least, block_pairs, named_rows


def _cells(df: DataFrame, side: float, reach: int) -> DataFrame:
    """df with gx, gy: its own grid cell, or with reach > 0 a row for each cell around."""
    gx, gy = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    if not reach:
        return df.withColumns({"gx": gx, "gy": gy})
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).withColumns({"gx": gx + F.col("dx"), "gy": gy + F.col("dy")}).drop("dx", "dy")


def _distance():
    return F.sqrt(F.pow(F.col("x") - F.col("nx"), 2) + F.pow(F.col("y") - F.col("ny"), 2))


def radius_join(centers: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """center, neighbor, dist of pairs at most `radius` apart (a center itself included if it is a point)."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    a = _cells(centers.select(F.col("barcode").alias("center"), "x", "y"), radius, 1)
    b = _cells(points.select("barcode", "x", "y"), radius, 0).select(F.col("barcode").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"), "gx", "gy")
    return a.join(b, ["gx", "gy"]).withColumn("dist", _distance()).where(F.col("dist") <= radius).select("center", "neighbor", "dist")


def knn_join(centers: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """center, neighbor, dist, rank of the k nearest points, ties by barcode; a center that is a point
    counts itself. Exact: a ring of grid cells is widened for those centers whose k-th neighbour may
    lie outside it, until none is left."""
    b = points.select("barcode", "x", "y")
    s = b.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = s["n"]
    schema_empty = centers.select(F.col("barcode").alias("center"), F.col("barcode").alias("neighbor"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    if not n:
        return schema_empty
    k = min(k, n)
    wide, high = max(s[2] - s[1], 1e-9), max(s[4] - s[3], 1e-9)
    side = max((wide * high * k / n) ** 0.5 / 2, max(wide, high) * 1e-4)
    most = int(max(wide, high) / side) + 2
    right = _cells(b, side, 0).select(F.col("barcode").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"), "gx", "gy")
    left, reach, done = centers.select(F.col("barcode").alias("center"), "x", "y"), 1, None
    order = W.partitionBy("center").orderBy("dist", "neighbor")
    while True:
        near = _cells(left, side, reach).join(right, ["gx", "gy"]).withColumn("dist", _distance()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if reach < most:
            near = cut(near.select("center", "neighbor", "dist", "rank"))
            full = near.where((F.col("rank") == k) & (F.col("dist") <= reach * side)).select("center")
            part = near.join(full, "center", "left_semi")
            left = cut(left.join(full, "center", "left_anti"))
            done = part if done is None else done.union(part)
            if left.isEmpty():
                return done
            reach = min(most, reach * 2)
        else:
            near = near.select("center", "neighbor", "dist", "rank")
            return near if done is None else done.union(near)


def nn_scale(cells: DataFrame, q: float = 0.999) -> DataFrame:
    """The quantile q of distances to the nearest other cell."""
    near = knn_join(cells, cells, 2).where("rank = 2")
    return near.agg(F.percentile("dist", q).alias("scale"))


def knn_graph(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Edges center, neighbor, rank by Euclidean distance of vectors (barcode, vec), self included. Vectors
    are compared in blocks; a centre keeps its k best of each block before they meet."""
    return nearest_vectors(embeddings, embeddings, k)


def _near(a, b, names, held, may=None) -> None:
    """Takes into held (blocks.Least) the rows of b (with names) that may be among the k nearest to each of a: a product says
    which, with room for its rounding, and their distances are then made from differences. may: which pairs count."""
    import numpy as np

    x, y = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d2 = x[:, None] + y - 2 * (a @ b.T)
    d2 = d2 if may is None else np.where(may, d2, np.inf)
    room = 1e-9 * (x.max() + y.max() + 1)
    if held.bound is not None:
        most = (held.bound + 1e-12) ** 2 + room
    else:
        most = np.partition(d2, held.k - 1, axis=1)[:, held.k - 1] + 2 * room if len(b) >= held.k else np.full(len(a), np.inf)
    near = d2 <= most[:, None]
    row, col = np.nonzero(near if may is None else near & may)
    d = np.concatenate([np.sqrt(((a[row[i : i + 65536]] - b[col[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(row), 65536)] or [np.zeros(0)])
    held.found(row, names[col], d, len(a), np.round(d, 12))


def closest(k: int):
    """Of rows with packs q and p (arrays of barcode, vec): the k points of p nearest to each of q, by blocks of queries."""

    def best(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for q, p in zip(f["q"], f["p"], strict=True):
                a, b = np.array([r["vec"] for r in q], float), np.array([r["vec"] for r in p], float)
                names, seeds = np.array([r["barcode"] for r in q], object), np.array([r["barcode"] for r in p], object)
                for i in range(0, len(a), 128):
                    held = Least(k)
                    _near(a[i : i + 128], b, seeds, held)
                    row, to, d = held.rows()
                    yield pd.DataFrame({"center": names[i + row], "neighbor": to, "dist": d})

    return best


def nearest_vectors(queries: DataFrame, points: DataFrame, k: int, allowed: Callable | None = None) -> DataFrame:
    """center, neighbor, dist, rank of the k nearest points (barcode, vec) to each query, ties by barcode. All pairs are compared,
    block by block, and a task keeps its queries' k nearest. allowed: a function of two blocks that says which pairs count."""
    kind = queries.schema["barcode"].dataType.simpleString()

    def run(q, blocks):
        import pyarrow as pa

        a = q["vec"]
        at = range(0, len(a), 128)
        held = [Least(k) for _ in at]
        for s in blocks:
            names, may = named_rows(s), None if allowed is None else allowed(q, s)
            for i, h in zip(at, held, strict=True):
                _near(a[i : i + 128], s["vec"], names, h, None if may is None else may[i : i + 128])
        for i, h in zip(at, held, strict=True):
            row, to, d = h.rows()
            yield pa.RecordBatch.from_arrays([q["barcode"].take(pa.array(row + i)), pa.array(to.tolist(), s["barcode"].type), pa.array(d)], names=["center", "neighbor", "dist"])

    extra = [c for c in points.columns if c not in ("barcode", "vec")] if allowed is not None else []
    some = block_pairs(queries.select("barcode", "vec"), points.select("barcode", "vec", *extra), run, f"center {kind}, neighbor {kind}, dist double")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("center").orderBy(F.round("dist", 12), "neighbor"))).where(F.col("rank") <= k)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """barcode, component (its smallest barcode): labels spread along edges (a, b) and jump to the label
    of their label until nothing changes; nodes without edges are components of their own."""
    both = cut(edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(nodes.select("barcode", F.col("barcode").alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("barcode")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("barcode") == F.col("a"), "left").select("barcode", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("was"))
        up = step.select(F.col("barcode").alias("component"), F.col("component").alias("top"))
        new = cut(step.join(up, "component", "left").select("barcode", F.least("component", F.coalesce("top", "component")).alias("component"), "was"))
        changed = not new.where("component <> was").isEmpty()
        labels = new.select("barcode", "component")
        if not changed:
            return labels


def spread(cells: DataFrame, radius: float, seed: int = 1) -> DataFrame:
    """barcode, x, y of centres more than radius apart such that no cell is farther than radius from one: a maximal
    independent set of the radius graph, by rounds in which cells with the least hash around them become centres and
    cells near them go. Only the least cell of each square of side radius / 2 stands in a round, so that a cell meets 25
    others at most, however dense the cells are."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    side = radius / 2
    square = {"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)}
    left = cut(cells.select("barcode", "x", "y").withColumns({**square, "p": F.struct(F.xxhash64("barcode", F.lit(seed)).alias("h"), "barcode")}))
    step, centers = F.sequence(F.lit(-2), F.lit(2)), None

    def met(df: DataFrame, others: DataFrame) -> DataFrame:
        around = df.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"gx": F.col("gx") + F.col("i"), "gy": F.col("gy") + F.col("j")})
        other = others.select("gx", "gy", F.col("p").alias("np"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        return around.join(other, ["gx", "gy"]).where(_distance() <= radius)

    while not left.isEmpty():
        standing = cut(left.groupBy("gx", "gy").agg(F.min(F.struct("p", "x", "y")).alias("c")).select("gx", "gy", "c.p", "c.x", "c.y"))
        beaten = met(standing, standing).where("np < p").select("p").distinct()
        new = cut(standing.join(beaten, "p", "left_anti"))
        centers = new if centers is None else centers.union(new)
        left = cut(left.join(met(left, new).select("p").distinct(), "p", "left_anti"))
    return cells.select("barcode", "x", "y").limit(0) if centers is None else centers.select("p.barcode", "x", "y")


def hops(edges: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """center, neighbor, hops of nodes at most `depth` edges apart (self at 0); edges a, b both ways."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    out = nodes.select(F.col("barcode").alias("center"), F.col("barcode").alias("neighbor"), F.lit(0).alias("hops"))
    front = out
    for d in range(1, depth + 1):
        front = front.join(both, F.col("neighbor") == F.col("a")).select("center", F.col("b").alias("neighbor"), F.lit(d).alias("hops")).distinct().join(out, ["center", "neighbor"], "left_anti")
        out = cut(out.union(front))
    return out


def hex_grid(cells: DataFrame, n_centers: int) -> DataFrame:
    """node, x, y of a hexagonal grid over the cells' bounding box, and the nearest barcode of each."""
    d = int(-(-(n_centers**0.5) // 1))
    if d < 2:
        raise ValueError("a hexagonal grid needs 2 centers or more")
    box = cells.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    row = box.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(d - 1)))).withColumn("y", F.col("r") * (F.col("my") + 1) / (d - 1))
    s = F.col("mx") / (d - 1) / 2
    even = F.col("r") % 2 == 0
    grid = row.withColumn("c", F.explode(F.sequence(F.lit(0), F.when(even, F.lit(d)).otherwise(F.lit(d - 1)))))
    x = F.when(even, -s + F.col("c") * (F.col("mx") + 2 * s) / d).otherwise(F.col("c") * F.col("mx") / (d - 1))
    nodes = grid.select((F.col("r") * (d + 1) + F.col("c")).cast("string").alias("barcode"), x.alias("x"), "y")
    near = knn_join(nodes, cells, 1)
    return nodes.withColumnRenamed("barcode", "node").join(near.select(F.col("center").alias("node"), F.col("neighbor").alias("barcode")), "node")
