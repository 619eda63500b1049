"""Latent-space embeddings (barcode, vec) of counts, each dimension scaled to [0, 1].

Decompositions work on the features' Gram matrix, summed up over the cells by each task, so what reaches
the driver has the size of the (variable) features squared, whatever the number of cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .mapping import dense
from .normalize import log_norm, tfidf, variable_features

METHODS = ("PCA", "PCA_L", "NMF", "LSI", "UMAP", "LSI_UMAP")


def gram(v: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum and Gram matrix of vec."""
    size = len(v.first()["vec"])

    def part(frames):
        import pandas as pd

        n, s, g = 0, np.zeros(size), np.zeros((size, size))
        for f in frames:
            x = np.array(f["vec"].tolist())
            if len(x):
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

    n, s, g = 0, np.zeros(size), np.zeros((size, size))
    for r in v.select("vec").mapInPandas(part, "n long, s array<double>, g array<double>").toLocalIterator():
        n, s, g = n + r["n"], s + np.array(r["s"]), g + np.array(r["g"]).reshape(size, size)
    return n, s, g


def _mapped(v: DataFrame, fn) -> DataFrame:
    kind = v.schema["barcode"].dataType.simpleString()

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                yield pd.DataFrame({"barcode": f["barcode"], "vec": fn(np.array(f["vec"].tolist())).tolist()})

    return v.select("barcode", "vec").mapInPandas(run, f"barcode {kind}, vec array<double>")


def scaled(v: DataFrame) -> DataFrame:
    ends = v.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("e"))
    return v.crossJoin(F.broadcast(ends)).select("barcode", F.transform("vec", lambda x, i: F.when(F.col("e")[i]["hi"] > F.col("e")[i]["lo"], (x - F.col("e")[i]["lo"]) / (F.col("e")[i]["hi"] - F.col("e")[i]["lo"])).otherwise(x)).alias("vec"))


def _signed(u: np.ndarray) -> np.ndarray:
    return u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])


def pca(v: DataFrame, dims: int, scale: bool = True) -> tuple[DataFrame, np.ndarray]:
    """Scores (unscaled) and loadings (features x dims) of standardised features."""
    n, s, g = gram(v)
    m = s / n
    cov = (g - n * np.outer(m, m)) / (n - 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0)) if scale else np.ones(len(m))
    sd[sd == 0] = 1
    w, u = np.linalg.eigh(cov / np.outer(sd, sd))
    u = _signed(u[:, np.argsort(-w)[:dims]])
    return _mapped(v, lambda x: ((x - m) / sd) @ u), u


def lsi(v: DataFrame, dims: int, remove_first: bool = True) -> DataFrame:
    """Singular vectors of uncentred features; one more is taken and the first dropped with remove_first."""
    _, _, g = gram(v)
    w, u = np.linalg.eigh(g)
    order = np.argsort(-w)[: dims + 1]
    order = order[1:] if remove_first else order[:dims]
    u, s = _signed(u[:, order]), np.sqrt(np.maximum(w[order], 1e-12))
    return _mapped(v, lambda x: x @ u / s)


def nmf(v: DataFrame, dims: int, iterations: int = 60, seed: int = 1) -> DataFrame:
    """Multiplicative updates: W of the features on the driver, from sums over cells; H cell by cell."""
    size = len(v.first()["vec"])
    w = np.random.default_rng(seed).random((size, dims)) + 0.1

    def solve(x, w, steps=30):
        h, wx, ww = np.full((len(x), dims), 0.5), x @ w, w.T @ w
        for _ in range(steps):
            h *= wx / (h @ ww + 1e-9)
        return h

    for _ in range(max(1, iterations // 30)):
        def part(frames, w=w):
            import pandas as pd

            a, b = np.zeros((size, dims)), np.zeros((dims, dims))
            for f in frames:
                if len(f):
                    x = np.array(f["vec"].tolist())
                    h = solve(x, w)
                    a, b = a + x.T @ h, b + h.T @ h
            yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.ravel().tolist()]})

        a, b = np.zeros((size, dims)), np.zeros((dims, dims))
        for r in v.select("vec").mapInPandas(part, "a array<double>, b array<double>").toLocalIterator():
            a, b = a + np.array(r["a"]).reshape(size, dims), b + np.array(r["b"]).reshape(dims, dims)
        for _ in range(30):
            w = w * a / (w @ b + 1e-9)
    return _mapped(v, lambda x: solve(x, w))


def loading_sum(counts: DataFrame, loadings: DataFrame) -> DataFrame:
    """barcode, dim, value: for each cell and component the sum of |loading| over features with counts."""
    return counts.where("value > 0").join(loadings, "feature").groupBy("barcode", "dim").agg(F.sum(F.abs("loading")).alias("value"))


def umap_layout(v: DataFrame, dims: int = 3, k: int = 15, epochs: int = 60, seed: int = 1) -> DataFrame:
    """Three-dimensional layout of the fuzzy k-neighbour graph. The graph is made in Spark; attraction and
    sampled repulsion run on the driver, whose memory bounds the number of cells (k rows of each)."""
    from .spatial import nearest_vectors

    spark = v.sparkSession
    kind = v.schema["barcode"].dataType.simpleString()
    start, _ = pca(v, dims)
    first = {r["barcode"]: r["vec"] for r in start.collect()}
    names = sorted(first)
    at = {n: i for i, n in enumerate(names)}
    e = nearest_vectors(v, v, k + 1).where("center <> neighbor").select("center", "neighbor", "dist").collect()
    i, j, d = np.array([at[r["center"]] for r in e]), np.array([at[r["neighbor"]] for r in e]), np.array([r["dist"] for r in e])
    low = np.full(len(names), np.inf)
    np.minimum.at(low, i, d)
    mean = np.bincount(i, d, len(names)) / np.maximum(1, np.bincount(i, minlength=len(names)))
    p = np.exp(-np.maximum(0, d - low[i]) / np.maximum(1e-9, mean[i] - low[i] + 1e-9))
    y = np.array([first[n] for n in names])
    y = 10 * (y - y.mean(axis=0)) / (y.std(axis=0) + 1e-9)
    rng = np.random.default_rng(seed)
    for t in range(epochs):
        rate = 1 - t / epochs
        diff = y[i] - y[j]
        q = (diff**2).sum(axis=1, keepdims=True)
        pull = np.clip(-2 / (1 + q) * diff * p[:, None], -4, 4) * rate * 0.2
        other = rng.integers(0, len(names), len(i))
        away = y[i] - y[other]
        q = (away**2).sum(axis=1, keepdims=True)
        push = np.clip(2 / ((0.01 + q) * (1 + q)) * away, -4, 4) * rate * 0.1
        for axis in range(dims):
            y[:, axis] += np.bincount(i, pull[:, axis] + push[:, axis], len(names)) - np.bincount(j, pull[:, axis], len(names))
    return spark.createDataFrame([(n, list(map(float, r))) for n, r in zip(names, y, strict=True)], f"barcode {kind}, vec array<double>")


def generate_embeddings(counts: DataFrame, cells: DataFrame, dim_reduction: str = "PCA", normalization: str = "log_norm", dims: int = 30, n_features: int = 2000, features: list[str] | None = None, remove_lsi_1: bool = True) -> DataFrame:
    """Normalise, choose features (variable ones, or those given), reduce, scale."""
    if dim_reduction not in METHODS:
        raise ValueError(f"unknown reduction {dim_reduction!r}: {', '.join(METHODS)}")
    if normalization not in ("log_norm", "TFIDF", "none", "SCT", "SCTransform"):
        raise ValueError(f"unknown normalisation {normalization!r}")
    n = cells.select("barcode").distinct().count()
    if normalization in ("SCT", "SCTransform"):
        from .normalize import pearson_residuals

        norm = pearson_residuals(counts, n)
    else:
        norm = {"log_norm": log_norm, "TFIDF": tfidf, "none": lambda c: c}[normalization](counts)
    norm = cut(norm)  # read some times from here on, and made once
    chosen = norm.where(F.col("feature").isin(features)).select("feature").distinct() if features else variable_features(norm, n, n_features).select("feature")
    v = cut(dense(norm, cells, chosen))
    if dim_reduction == "PCA":
        return scaled(pca(v, dims)[0])
    if dim_reduction == "PCA_L":
        u = pca(v, dims)[1]
        names = [r[0] for r in chosen.orderBy("feature").collect()]
        load = v.sparkSession.createDataFrame([(f, d + 1, float(u[i, d])) for i, f in enumerate(names) for d in range(u.shape[1])], "feature string, dim int, loading double")
        s = loading_sum(norm, load).groupBy("barcode").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("s"))
        return scaled(s.select("barcode", F.transform("s", lambda x: x["value"]).alias("vec")))
    if dim_reduction == "NMF":
        return scaled(nmf(v, dims))
    if dim_reduction == "LSI":
        return scaled(lsi(v, dims, remove_lsi_1))
    return scaled(umap_layout(v if dim_reduction == "UMAP" else lsi(v, dims, remove_lsi_1)))
