"""Approximate nearest vectors by inverted lists: centres from a bounded sample, every point in the list of its nearest
centre, every query against the lists of its nearest few, as many as a measured recall takes. Lists of any length are cut into packs, so a dense spot of
points is many small products. `spatial.nearest_vectors` is the exact version."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .spatial import closest, nearest_vectors

#: Vectors that centres are learned from, centres at most, points (or queries) of a pack, queries that recall is measured on.
SAMPLE, CENTRES, PACK, TRIED = 50_000, 4096, 2048, 256
#: Lists that queries are copied to. Where each is compared with more, its block meets the points' blocks instead, and pairs
#: whose list it does not probe don't count: disk then grows with the points, not with their number times the lists'.
COPIES = 16


def learn_centres(points: DataFrame, n_lists: int | None = None, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """k-means centres of a hashed sample of SAMPLE points at most. n_lists: the root of the number of points by default."""
    n = points.count()
    lists = min(CENTRES, n_lists or max(1, round(math.sqrt(n))))
    h = F.xxhash64("barcode", F.lit(seed))
    # a threshold instead of a sort of all points
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    rows = points.where(F.pmod(h, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy(h).limit(SAMPLE).select("vec").collect()
    x = np.array([r["vec"] for r in rows], float)
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = size == 0
        c = np.where(empty[:, None], x[rng.integers(0, len(x), len(c))], total / np.maximum(size, 1)[:, None])
    return c


def _lists(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """barcode, vec and list: a row for each of the `probes` nearest centres."""
    kind = df.schema["barcode"].dataType.simpleString()
    norm = (centres**2).sum(1)

    def run(frames):
        for f in frames:
            if len(f):
                x = np.array(f["vec"].tolist(), float)
                d = norm - 2 * x @ centres.T
                at = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
                out = f.loc[f.index.repeat(at.shape[1]), ["barcode", "vec"]]
                yield out.assign(list=at.ravel().astype("int64"))

    return df.select("barcode", "vec").mapInPandas(run, f"barcode {kind}, vec array<double>, list long")


def _probed(centres: np.ndarray, probes: int):
    """A function of vectors: which lists (columns) are among the `probes` nearest of each."""
    norm = (centres**2).sum(1)

    def of(x):
        d = norm - 2 * x @ centres.T
        out = np.ones(d.shape, bool)
        if probes < len(centres):
            out[:] = False
            np.put_along_axis(out, np.argpartition(d, probes - 1, axis=1)[:, :probes], True, axis=1)
        return out

    return of


def _packs(rows: DataFrame, name: str) -> DataFrame:
    """list and `name`: arrays of about PACK rows of a list."""
    size = rows.groupBy("list").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
    dealt = rows.join(size, "list").withColumn("pack", F.pmod(F.xxhash64("barcode"), F.col("packs")))
    return dealt.groupBy("list", "pack").agg(F.collect_list(F.struct("barcode", "vec")).alias(name)).drop("pack")


def probes_for(points: DataFrame, held: DataFrame, centres: np.ndarray, k: int, target: float, queries: DataFrame, seed: int = 1) -> int:
    """The fewest lists a query must be compared with so that a share `target` of the k nearest points is found, measured on
    TRIED hashed queries against all points: for each true neighbour, how many centres are nearer than its list's."""
    tried = cut(queries.select("barcode", "vec").orderBy(F.xxhash64("barcode", F.lit(seed + 1))).limit(TRIED))
    true = nearest_vectors(tried, points, k).select("center", "neighbor")
    where = true.join(held.select(F.col("barcode").alias("neighbor"), "list"), "neighbor").join(tried.withColumnRenamed("barcode", "center"), "center").select("vec", "list").collect()
    if not where:
        return 1
    x, at = np.array([r["vec"] for r in where], float), np.array([r["list"] for r in where])
    d = (centres**2).sum(1) - 2 * x @ centres.T
    nearer = np.sort((d < d[np.arange(len(at)), at][:, None]).sum(1))
    return int(nearer[min(len(nearer) - 1, math.ceil(target * len(nearer)) - 1)]) + 1


def nearest(queries: DataFrame, points: DataFrame, k: int, target: float = 0.97, probes: int | None = None, n_lists: int | None = None, seed: int = 1) -> DataFrame:
    """center, neighbor, dist, rank of about the k nearest points (barcode, vec); ties by barcode; a query that is a point
    counts itself. probes: lists that a query is compared with, by default as many as `target` takes on a sample of
    queries. Where probes reach all lists the result is exact."""
    centres = learn_centres(points, n_lists, seed)
    if not len(centres):
        return queries.select(F.col("barcode").alias("center"), F.col("barcode").alias("neighbor"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank")).limit(0)
    kind = queries.schema["barcode"].dataType.simpleString()
    held = cut(_lists(points, centres, 1))
    probes = min(len(centres), probes or probes_for(points, held, centres, k, target, queries, seed))
    if probes > COPIES:
        lists = _probed(centres, probes)
        return nearest_vectors(queries, held, k, lambda q, s: lists(q["vec"])[:, s["list"]])
    pairs = _packs(cut(_lists(queries, centres, probes)), "q").join(_packs(held, "p"), "list").select("q", "p").repartition(F.xxhash64(F.col("q")[0]["barcode"], F.col("p")[0]["barcode"]))
    some = pairs.mapInPandas(closest(k), f"center {kind}, neighbor {kind}, dist double")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("center").orderBy(F.round("dist", 12), "neighbor"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the share of exact neighbours that were found."""
    hit = exact.select("center", "neighbor").join(found.select("center", "neighbor", F.lit(1).alias("hit")), ["center", "neighbor"], "left")
    return hit.agg(F.count_distinct("center").alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
