"""Counts that arrive as files: long rows summed up continuously. The batch operators take the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def count_stream(spark: SparkSession, path: str, schema: str = "feature string, barcode string, value double", files: int | None = None) -> DataFrame:
    """Running sums (feature, barcode, value) of Parquet files of long counts; write with outputMode
    complete or update. files: how many new files a micro-batch takes at most."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path).groupBy("feature", "barcode").agg(F.sum("value").alias("value"))
