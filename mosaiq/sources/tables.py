"""Coordinates, counts and images as DataFrames, with the checks of an assay's constructor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_coordinates(df: DataFrame) -> DataFrame:
    """barcode, x, y from columns named barcodes with xcoord, ycoord or x, y; other columns go."""
    names = set(df.columns)
    for b, x, y in (("barcodes", "xcoord", "ycoord"), ("barcodes", "x", "y"), ("barcode", "x", "y")):
        if {b, x, y} <= names:
            return df.select(F.col(b).cast("string").alias("barcode"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    raise ValueError("coordinates need the columns barcodes, xcoord, ycoord or barcodes, x, y")


def read_counts(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Long sparse counts (feature, barcode, value; zeros left out) from long rows or from a table with
    a column for each barcode."""
    if {"feature", "barcode", "value"} <= set(df.columns):
        return df.select(F.col("feature").cast("string").alias("feature"), F.col("barcode").cast("string").alias("barcode"), F.col("value").cast("double").alias("value")).where("value <> 0")
    if feature not in df.columns:
        raise ValueError("counts need feature, barcode, value or a feature column with a column for each barcode")
    cells = [c for c in df.columns if c != feature]
    if len(set(cells)) < len(cells):
        raise ValueError("duplicated barcodes in counts")
    return df.unpivot([feature], cells, "barcode", "value").select(F.col(feature).cast("string").alias("feature"), "barcode", F.col("value").cast("double").alias("value")).where("value <> 0")


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """channel, x, y, value of image files, value in [0, 1]; the image source decodes in the JVM."""
    img = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def pixels(frames):
        import numpy as np
        import pandas as pd

        for f in frames:
            for r in f.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[:, :, ::-1] / 255.0
                y, x, c = np.indices(a.shape)
                yield pd.DataFrame({"origin": r.origin, "channel": c.ravel() + 1, "x": x.ravel() + 1, "y": y.ravel() + 1, "value": a.ravel()})

    return img.mapInPandas(pixels, "origin string, channel int, x int, y int, value double")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
