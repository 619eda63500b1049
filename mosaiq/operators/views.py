"""Plot-ready frames: what a plot of an assay would draw, as rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rebalance_colors(values: DataFrame, method: str = "minmax") -> DataFrame:
    """barcode, dim, value scaled to [0, 1] within each channel, or truncated to it."""
    if method == "truncate":
        return values.withColumn("value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "value")))
    w = W.partitionBy("dim")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return values.select("barcode", "dim", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.col("value")).alias("value"))


def image_plot(values: DataFrame, tiles: DataFrame, dims: list[int]) -> DataFrame:
    """x, y, r, g, b of each pixel: one dimension as grey, three as colours."""
    if len(dims) not in (1, 3):
        raise ValueError("an image shows 1 or 3 dimensions")
    c = rebalance_colors(values.where(F.col("dim").isin(dims)))
    at = lambda i: F.max(F.when(F.col("dim") == dims[min(i, len(dims) - 1)], F.col("value")))
    return tiles.join(c.groupBy("barcode").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b")), "barcode").select("x", "y", "r", "g", "b")


def order_labels(labels: DataFrame) -> DataFrame:
    """label, rank: numbers in order, then other words, `isolated` and `Not Selected` last."""
    last = F.col("label").isin("isolated", "Not Selected")
    num = F.expr("try_cast(label AS double)")
    return labels.select("label").distinct().withColumn("rank", F.row_number().over(W.orderBy(last, num.asc_nulls_last(), "label")))


def territory_plot(cells: DataFrame, highlight: list[str] | None = None, alpha: float = 0.65, contour: str = "None") -> DataFrame:
    """barcode, x, y, territory, color (rank of the label) and alpha (0.15 of it off the highlight); with
    contour `convex` the hull's points of each territory in angular order, isolated ones left out."""
    ranks = order_labels(cells.select(F.col("territory").alias("label")))
    out = cells.join(ranks, F.col("territory") == F.col("label")).select("barcode", "x", "y", "territory", F.col("rank").alias("color"))
    a = F.lit(alpha) if highlight is None else F.when(F.col("territory").isin([str(h) for h in highlight]), F.lit(alpha)).otherwise(F.lit(0.15 * alpha))
    out = out.withColumn("alpha", a)
    if contour == "None":
        return out

    def hull(f):
        pts = sorted(set(zip(f["x"], f["y"], strict=True)))

        def half(ps):
            h = []
            for p in ps:
                while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                    h.pop()
                h.append(p)
            return h[:-1]

        import pandas as pd

        ring = half(pts) + half(pts[::-1]) if len(pts) > 2 else pts
        return pd.DataFrame({"territory": f["territory"].iloc[0], "step": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    return out.where("territory <> 'isolated'").groupBy("territory").applyInPandas(hull, "territory string, step int, x double, y double")


def gene_expression(counts: DataFrame, cells: DataFrame, genes: list[str], as_layer: bool = False, norm: bool = True) -> DataFrame:
    """feature, barcode, x, y, territory, value of the genes (0 where absent); as_layer: the territory's
    mean; norm: scaled to [0, 1] within a gene. Genes not in the counts are left out with a warning."""
    have = {r[0] for r in counts.where(F.col("feature").isin(genes)).select("feature").distinct().collect()}
    if lost := [g for g in genes if g not in have]:
        warnings.warn(f"not in the counts: {lost}", stacklevel=2)
    grid = cells.withColumn("feature", F.explode(F.array(*[F.lit(g) for g in sorted(have)]) if have else F.array().cast("array<string>")))
    v = grid.join(counts.where(F.col("feature").isin(sorted(have))), ["feature", "barcode"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if as_layer:
        v = v.withColumn("value", F.avg("value").over(W.partitionBy("feature", "territory")))
    if norm:
        w = W.partitionBy("feature")
        lo, hi = F.min("value").over(w), F.max("value").over(w)
        v = v.withColumn("value", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.col("value")))
    return v.select("feature", "barcode", "x", "y", "territory", "value")


def mapping_metrics(aligned: DataFrame, matches: DataFrame, trial: str = "cost") -> DataFrame:
    return aligned.join(matches.select("from", "to", F.col(trial).alias("value")), ["from", "to"]).select("barcode", "x", "y", "value")
