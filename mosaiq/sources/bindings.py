"""Stand-ins for spatial data: assays bound to the tables of the test schema, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{t}.parquet")


def retail_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers on a lattice 40 wide: barcode, x, y, territory, cell_type."""
    k = F.col("c_custkey")
    return _read(spark, sf, "customer").select(k.cast("string").alias("barcode"), (k % 40).cast("double").alias("x"), F.floor(k / 40).cast("double").alias("y"), F.col("c_mktsegment").alias("territory"), F.col("c_nationkey").alias("cell_type"))


def retail_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity of each brand that each customer bought: feature, barcode, value."""
    li = _read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = _read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = _read(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), F.col("o_custkey").cast("string").alias("barcode")).agg(F.sum("l_quantity").alias("value"))


def latent_assay(spark: SparkSession, sf: str) -> DataFrame:
    """barcode (long), vec (doubles), segment, x, y."""
    v = F.col("vec_id")
    return _read(spark, sf, "embeddings").select(v.alias("barcode"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("segment"), (v % 25).cast("double").alias("x"), F.floor(v / 25).cast("double").alias("y"))


def term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lower-case words of documents: feature, barcode, value."""
    d = _read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("barcode"), F.explode(F.split(F.lower("text"), r"[ \n]+")).alias("feature"))
    return d.where("feature <> ''").groupBy("feature", "barcode").agg(F.count("*").cast("double").alias("value"))


def events_points(spark: SparkSession, sf: str) -> DataFrame:
    """Events as points: barcode, x (user), y (value in tens), label."""
    return _read(spark, sf, "events").select(F.col("event_id").cast("string").alias("barcode"), F.col("user_id").cast("double").alias("x"), F.floor(F.col("value") / 10).cast("double").alias("y"), F.col("event_type").alias("label"))


CELLS = "cells AS (SELECT CAST(c_custkey AS VARCHAR) AS barcode, CAST(c_custkey % 40 AS DOUBLE) AS x, floor(c_custkey / 40) AS y, c_mktsegment AS territory, c_nationkey AS cell_type FROM customer)"
COUNTS = "counts AS (SELECT p_brand AS feature, CAST(o_custkey AS VARCHAR) AS barcode, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
LATENT = "latent AS (SELECT vec_id AS barcode, CAST(embedding AS DOUBLE[]) AS vec, label AS segment, CAST(vec_id % 25 AS DOUBLE) AS x, floor(vec_id / 25) AS y FROM embeddings)"
TERMS = r"terms AS (SELECT feature, barcode, CAST(count(*) AS DOUBLE) AS value FROM (SELECT CAST(doc_id AS VARCHAR) AS barcode, unnest(regexp_split_to_array(lower(text), '[ \n]+')) AS feature FROM documents) WHERE feature <> '' GROUP BY ALL)"
POINTS = "points AS (SELECT CAST(event_id AS VARCHAR) AS barcode, CAST(user_id AS DOUBLE) AS x, floor(value / 10) AS y, event_type AS label FROM events)"
