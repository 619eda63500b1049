"""Positions, running sums and digests over a global order, without a task that reads all rows.

An order is dealt out by ranges of its key; each range counts its own rows, the counts of the ranges (a row
each) are summed up, and every range adds what lies before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows that one window sorts, and block totals that one task sums up.
BLOCK = 8192


def ranges(df: DataFrame, *by: Column) -> DataFrame:
    """df written with __p, the number of the range of `by` that a row is in: ranges ascend, and rows of equal
    keys share one. For keys that don't repeat, so that ranges are about equal."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *by).withColumn("__p", F.spark_partition_id()))


def positions(df: DataFrame, *by: Column, at: str = "at") -> DataFrame:
    """df (written) with `at`: the row's place from 0 in the order of `by`."""
    parted = ranges(df, *by)
    before = parted.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__p").orderBy(*by)) - 1
    return written(parted.withColumn("__own", own).join(before, "__p").withColumn(at, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before"))


def running(df: DataFrame, at: str, *values: str) -> DataFrame:
    """df with run_<value>: the sum of each value over all rows up to this one. `at`: places from 0 without gaps or
    repeats, or ascending numbers of blocks. df is read several times, so it should be a written table."""
    last = df.agg(F.max(at)).first()[0] or 0
    if last < BLOCK:
        return df.withColumns({f"run_{v}": F.sum(v).over(W.orderBy(at)) for v in values})
    block = f"{at}_" if at.startswith("__b") else "__b"  # a name of its own at each level
    blocked = df.withColumn(block, F.floor(F.col(at) / BLOCK))
    totals = blocked.groupBy(block).agg(*[F.sum(v).alias(v) for v in values])
    if last // BLOCK >= BLOCK:
        totals = written(totals)
    before = running(totals, block, *values).select(block, *[(F.col(f"run_{v}") - F.col(v)).alias(f"__{v}") for v in values])
    within = {f"run_{v}": F.sum(v).over(W.partitionBy(block).orderBy(at)) for v in values}
    return blocked.withColumns(within).join(before, block).withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"__{v}") for v in values}).drop(block, *[f"__{v}" for v in values])


def run_digests(df: DataFrame, by: str, text: str, joint: str) -> DataFrame:
    """`by` and sha256 (lowercase hex of the texts in UTF-8, with `joint` between them) of each run of rows with one
    value of `by`. The rows of a group lie together and in order in one partition; they stream by, so a group of any
    size takes a batch of memory. A null text counts as empty."""
    kind = df.schema[by].dataType
    sep = joint.encode()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running_hash = None, None
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if running_hash is None or k != key:
                    if running_hash is not None:
                        done.append((key, running_hash.hexdigest()))
                    key, running_hash = k, hashlib.sha256()
                else:
                    running_hash.update(sep)
                running_hash.update((t or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field(0).type), pa.array([d[1] for d in done], pa.string())], names=[by, "sha256"])
        if running_hash is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type), pa.array([running_hash.hexdigest()], pa.string())], names=[by, "sha256"])

    return df.select(by, text).mapInArrow(digest, f"{by} {kind.simpleString()}, sha256 string")
