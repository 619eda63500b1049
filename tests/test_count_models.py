"""Count models against dense solvers that share no code with them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions.numeric import rank_sum_two_sided
from mosaiq.operators import count_models as cm
from mosaiq.operators import markers

G, N = 60, 240


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    depth, level = rng.uniform(0.4, 2.5, N), rng.uniform(0.3, 25, G)
    group = np.where(np.arange(N) < 80, "a", np.where(np.arange(N) < 170, "b", "c"))
    disp = 0.15 + 1.5 / level * rng.uniform(0.6, 1.6, G)
    mu = level[:, None] * depth
    mu[:12, group == "a"] *= 2.5
    y = rng.poisson(rng.gamma(1 / disp[:, None], mu * disp[:, None])).astype(float)
    y[30, group == "a"] = 0
    return y, group


@pytest.fixture(scope="module")
def frames(spark, data):
    y, group = data
    counts = spark.createDataFrame([(f"g{g:02d}", f"c{j:03d}", float(y[g, j])) for g in range(G) for j in range(N) if y[g, j]], "feature string, barcode string, value double").cache()
    cells = spark.createDataFrame([(f"c{j:03d}", str(group[j])) for j in range(N)], "barcode string, territory string").cache()
    return counts, cells


def trimmed_means(y):
    total = y.sum(0)
    q = np.quantile(y / total, 0.75, axis=0)
    ref = int(np.argmax(np.sqrt(y).sum(0))) if np.median(q) < 1e-20 else int(np.argmin(np.abs(q - q.mean())))
    out = []
    for j in range(y.shape[1]):
        both = (y[:, j] > 0) & (y[:, ref] > 0)
        a, b = y[both, j], y[both, ref]
        ratio, mean = np.log2(a / total[j] / (b / total[ref])), (np.log2(a / total[j]) + np.log2(b / total[ref])) / 2
        var = (total[j] - a) / total[j] / a + (total[ref] - b) / total[ref] / b
        rank = lambda x: np.array([(x.round(9) < v).sum() + ((x.round(9) == v).sum() + 1) / 2 for v in x.round(9)])
        n = len(a)
        lo, hi = math.floor(n * 0.3) + 1, math.floor(n * 0.05) + 1
        k = (rank(ratio) >= lo) & (rank(ratio) <= n + 1 - lo) & (rank(mean) >= hi) & (rank(mean) <= n + 1 - hi)
        out.append(0.0 if not n or np.abs(ratio).max() < 1e-6 else (ratio[k] / var[k]).sum() / (1 / var[k]).sum())
    out = np.array(out)
    return 2 ** (out - out.mean())


def test_factors(data, frames):
    y, _ = data
    got = {r["barcode"]: r for r in cm.trimmed_mean_factors(frames[0]).collect()}
    assert np.allclose([got[f"c{j:03d}"]["factor"] for j in range(N)], trimmed_means(y))
    assert np.allclose([got[f"c{j:03d}"]["total"] for j in range(N)], y.sum(0))
    logs = np.log1p(y)
    want = np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))
    got = {r["barcode"]: r["factor"] for r in cm.median_ratio_factors(*frames).collect()}
    assert np.allclose([got[f"c{j:03d}"] for j in range(N)], want)


def golden(f, lo, hi):
    a, b, g = lo, hi, (math.sqrt(5) - 1) / 2
    for _ in range(70):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(c) > f(d) else (c, b)
    return (a + b) / 2


LG = np.vectorize(math.lgamma)


def dense_loglik(y, size, level, disp):
    """The whole negative-binomial log likelihood, cell by cell."""
    mu, r = size * np.exp(level), 1 / disp
    return float((LG(y + r) - math.lgamma(r) - LG(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum())


def dense_level(y, size, disp):
    return golden(lambda v: dense_loglik(y, size, v, disp), math.log((y.sum() + 1e-12) / size.sum()) - 3, math.log((y.sum() + 1e-12) / size.sum()) + 3) if y.sum() else -60.0


def dense_lr(y, size, seed, disp):
    best = lambda k: dense_loglik(y[k], size[k], dense_level(y[k], size[k], disp), disp) if y[k].sum() else 0.0
    return 2 * (best(seed) + best(~seed) - best(np.ones(len(y), bool)))


def dense_profile(y, size, seed, disp):
    out = 0.0
    for k in (seed, ~seed):
        if y[k].sum():
            v = dense_level(y[k], size[k], disp)
            mu = size[k] * math.exp(v)
            out += dense_loglik(y[k], size[k], v, disp) - 0.5 * math.log((mu / (1 + disp * mu)).sum())
        else:
            out += 0.0
    return out


def chi_tail(x):
    return math.erfc(math.sqrt(max(x, 0) / 2))


def _rest(counts, cells, model):
    kept = markers.metrics_of_rest(counts, cells).withColumn("scope", F.lit(""))
    labels = cells.select("barcode", F.lit("").alias("scope"), F.col("territory").alias("label"))
    return {(r["pair"], r["feature"]): r for r in model(counts, labels, kept).collect()}


def test_quasi_likelihood_equals_dense_solver(data, frames):
    y, group = data
    found = _rest(*frames, cm.quasi_likelihood)
    size = y.sum(0) * trimmed_means(y)
    size = size / math.exp(np.log(y.sum(0)).mean())
    assert len(found) == 3 * G
    for g in range(0, G, 6):
        seed = group == "a"
        r = found["a", f"g{g:02d}"]
        assert abs(r["lr_p"] - chi_tail(dense_lr(y[g], size, seed, r["tagwise"]))) < 1e-4
        both = 0.0
        for k in (seed, ~seed):
            if y[g, k].sum():
                mu = size[k] * math.exp(dense_level(y[g, k], size[k], r["trend"]))
                v, d = y[g, k], r["trend"]
                both += 2 * float((np.where(v > 0, v * np.log(np.maximum(v, 1) / mu), 0) - (v + 1 / d) * np.log((1 + d * v) / (1 + d * mu))).sum())
        df = sum(k.sum() - 1 for k in (seed, ~seed) if y[g, k].sum())
        assert abs(r["s2"] - both / df) < 2e-3 * r["s2"]
    # true effects are found, others aren't, and the two tests differ
    p = {kind: np.array([found["a", f"g{g:02d}"][kind] for g in range(G)]) for kind in ("lr_p", "f_p")}
    assert (p["f_p"][:12] < 1e-3).all() and (p["lr_p"][:12] < 1e-3).all()
    assert np.abs(p["f_p"] - p["lr_p"]).max() > 0.01
    null = np.array([found["b", f"g{g:02d}"]["f_p"] for g in range(12, G) if g != 30])
    assert 0.3 < null.mean() < 0.7


def test_dispersions_peak_where_dense_profiles_do(data, frames):
    y, group = data
    found = _rest(*frames, cm.shrunk_dispersion)
    logs = np.log1p(y)
    size = np.exp(np.median(logs - logs.mean(1, keepdims=True), axis=0))
    seed = group == "a"
    for g in range(1, G, 7):
        r = found["a", f"g{g:02d}"]
        own = math.exp(golden(lambda v: dense_profile(y[g] + 1, size, seed, math.exp(v)), math.log(1e-4), math.log(100)))
        assert abs(math.log(r["own_dispersion"] / own)) < 0.03 or own < 3e-4
        assert abs(r["lr_p"] - chi_tail(dense_lr(y[g] + 1, size, seed, r["dispersion"]))) < 1e-4
        # between the feature's own dispersion and the trend
        lo, hi = sorted((r["own_dispersion"], r["trend"]))
        assert lo * 0.9 <= r["dispersion"] <= hi * 1.1
    assert max(found["a", f"g{g:02d}"]["lr_p"] for g in range(12)) < 1e-3


@pytest.mark.parametrize("method", ["QLF", "LRT", "DESeq2"])
def test_rest_equals_an_explicit_pair(frames, method):
    counts, cells = frames
    rest = {r["genes"]: r for r in markers.identify_markers(counts, cells, method=method, pval=1.0).collect() if r["seed"] == "a"}
    pair = {r["genes"]: r for r in markers.identify_markers(counts, cells, ["a"], ["b", "c"], method=method, pval=1.0).collect()}
    assert rest.keys() == pair.keys() and len(rest) > 20
    for g, r in rest.items():
        assert abs(r["p_value"] - pair[g]["p_value"]) < 1e-6 and abs(r["fold_change"] - pair[g]["fold_change"]) < 1e-6


@pytest.mark.parametrize("method", ["wilcox", "t.test", "chisq"])
def test_additive_sums_equal_rows_for_each_pair(frames, method):
    counts, cells = frames
    rest = {r["genes"]: r for r in markers.identify_markers(counts, cells, method=method, pval=1.0).collect() if r["seed"] == "b"}
    pair = {r["genes"]: r for r in markers.identify_markers(counts, cells, ["b"], ["a", "c"], method=method, pval=1.0).collect()}
    assert rest.keys() == pair.keys()
    assert all(abs(r["p_value"] - pair[g]["p_value"]) < 1e-9 for g, r in rest.items())


def test_exact_rank_sums(spark):
    import itertools

    for n1, n2 in ((1, 1), (2, 3), (4, 4), (5, 2)):
        sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for w in range(n1 * n2 + 1):
            tail = sum(s >= w for s in sums) if w > n1 * n2 / 2 else sum(s <= w for s in sums)
            assert abs(rank_sum_two_sided(w, n1, n2) - min(1, 2 * tail / len(sums))) < 1e-12
    rng = np.random.default_rng(1)
    v = rng.permutation(np.arange(1.0, 31)) ** 1.5
    counts = spark.createDataFrame([("g", f"{j}", float(v[j])) for j in range(30)], "feature string, barcode string, value double")
    cells = spark.createDataFrame([(f"{j}", "a" if j < 13 else "b") for j in range(30)], "barcode string, territory string")
    r = {x["seed"]: x["p_value"] for x in markers.identify_markers(counts, cells, pval=1.0, log_fc=0.0).collect()}
    w = int(sum((v[:13, None] > v[None, 13:]).ravel()))
    assert abs(r["a"] - rank_sum_two_sided(w, 13, 17)) < 1e-12 and abs(r["a"] - r["b"]) < 1e-12

