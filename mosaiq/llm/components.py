"""Connected components of a graph by alternating large-star and small-star steps.

Each round is joins and aggregates with map-side combination, written to the shared folder as Parquet
tables: a join has two plain exchanges, which adaptive execution splits where a node (the root of a large
component) has very many links. Links never reach the driver. checkpoint() would keep the estimated size of
the plan before it, a product for each join, whose digits grow fourfold each round until they fill the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, written


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b, and the smallest node that each is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of each batch by links to the smallest node."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, root = roots(u, v)
        inner = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(root[inner])], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """links: two long columns; nulls and loops are left out, repeated links count once. Returns node
    and root, the smallest node of its component, for each node that isn't a root itself."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col(a) != F.col(b)))
    e = written(mapped(pairs, _contract, "u long, v long").distinct())
    seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        small = written(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(small, "u")
        new = written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct())
        discard(e, least, large, small)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
