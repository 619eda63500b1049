"""Batch correction of embeddings by soft clusters that are held to a mixture of batches, and a ridge regression of each
cluster on batches. Each pass sums up, in every task, clusters by batches (by dimensions); those sums alone meet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ann import learn_centres

#: Batches at most, since each has a column in the tables of clusters that every task holds.
MOST_BATCHES = 1000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _soft(x: np.ndarray, b: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> np.ndarray:
    """Memberships (rows x clusters): nearness by cosine, times the penalty of the row's batch in each cluster."""
    logits = -2 * (1 - _unit(x) @ centres.T) / sigma + np.log(penalty)[b]
    r = np.exp(logits - logits.max(axis=1, keepdims=True))
    return r / r.sum(axis=1, keepdims=True)


def _summed(df: DataFrame, fn, size: int) -> np.ndarray:
    """The sum over all rows of fn(frame), arrays of `size` numbers, added up in each task and then by Spark."""

    def part(frames):
        import pandas as pd

        total = np.zeros(size)
        for f in frames:
            if len(f):
                total += fn(f)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "x": total[at]})

    out = np.zeros(size)
    for r in df.mapInPandas(part, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        out[r["i"]] = r["x"]
    return out


def correct(v: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 6, passes: int = 4, tolerance: float = 1e-3, seed: int = 1) -> DataFrame:
    """v (barcode, batch, vec) with vec corrected for batch. clusters: by default a thirtieth of the cells, 100 at most.
    theta: weight of the mixture of batches; sigma: softness. Rounds end when corrections move by less than tolerance
    of the vectors' spread. One batch, or none, changes nothing."""
    counts = {r["batch"]: r["n"] for r in v.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").limit(MOST_BATCHES + 1).collect()}
    if len(counts) > MOST_BATCHES:
        raise ValueError(f"more than {MOST_BATCHES} batches")
    if len(counts) < 2:
        return v.select("barcode", "batch", "vec")
    at = {b: i for i, b in enumerate(counts)}
    n, nb = sum(counts.values()), len(counts)
    share = np.array(list(counts.values())) / n
    kinds = f"barcode {v.schema['barcode'].dataType.simpleString()}, batch {v.schema['batch'].dataType.simpleString()}, vec array<double>, first array<double>"
    state = cut(v.select("barcode", "batch", "vec", F.col("vec").alias("first")))
    d = len(state.first()["vec"])
    k = clusters or int(min(100, max(2, round(n / 30))))
    centres = _unit(learn_centres(v.select("barcode", "vec"), k, seed))
    k = len(centres)
    before = np.zeros((k, nb, d))
    scale = float(np.sqrt(_summed(state, lambda f: np.array([(np.array(f["vec"].tolist()) ** 2).sum()]), 1)[0] / n)) or 1.0
    for _ in range(rounds):
        penalty = np.ones((nb, k))
        for _ in range(passes):
            def members(f, centres=centres, penalty=penalty):
                x, b = np.array(f["vec"].tolist()), f["batch"].map(at).to_numpy()
                r = _soft(x, b, centres, penalty, sigma)
                held = np.zeros((k, nb))
                np.add.at(held.T, b, r)
                return np.concatenate([held.ravel(), (r.T @ _unit(x)).ravel()])

            sums = _summed(state, members, k * nb + k * d)
            held, pull = sums[: k * nb].reshape(k, nb), sums[k * nb :].reshape(k, d)
            centres = _unit(np.where(held.sum(1, keepdims=True) > 1e-9, pull, centres))
            expected = held.sum(1, keepdims=True) * share
            penalty = (((expected + 1) / (held + 1)) ** theta).T

        def regress(f, centres=centres, penalty=penalty):
            x, b = np.array(f["vec"].tolist()), f["batch"].map(at).to_numpy()
            r, first = _soft(x, b, centres, penalty, sigma), np.array(f["first"].tolist())
            held, total = np.zeros((nb, k)), np.zeros((nb, k, d))
            np.add.at(held, b, r)
            for i in range(nb):
                total[i] = r[b == i].T @ first[b == i]
            return np.concatenate([held.ravel(), total.ravel()])

        sums = _summed(state, regress, nb * k + nb * k * d)
        held, total = sums[: nb * k].reshape(nb, k), sums[nb * k :].reshape(nb, k, d)
        shift = np.zeros((k, nb, d))
        for c in range(k):
            a = np.zeros((nb + 1, nb + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = held[:, c].sum(), held[:, c], held[:, c]
            a[1:, 1:] = np.diag(held[:, c] + ridge)
            if a[0, 0] > 1e-9:
                shift[c] = np.linalg.solve(a + 1e-12 * np.eye(nb + 1), np.vstack([total[:, c].sum(0), total[:, c]]))[1:]

        def moved(frames, centres=centres, penalty=penalty, shift=shift):
            for f in frames:
                if len(f):
                    x, b = np.array(f["vec"].tolist()), f["batch"].map(at).to_numpy()
                    r = _soft(x, b, centres, penalty, sigma)
                    off = np.einsum("nk,nkd->nd", r, shift[:, b].transpose(1, 0, 2))
                    yield f.assign(vec=list(np.array(f["first"].tolist()) - off))

        state = cut(state.mapInPandas(moved, kinds))
        if np.abs(shift - before).max() <= tolerance * scale:
            break
        before = shift
    return state.select("barcode", "batch", "vec")
