"""Batch correction and variance-stabilised features."""

from __future__ import annotations

import numpy as np

from mosaiq.operators import harmony, normalize


def _mixing(x, other, k=10):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :k]
    return (other[near] != other[:, None]).mean()


def test_correction_mixes_batches_and_keeps_kinds(spark):
    rng = np.random.default_rng(3)
    kind, batch = rng.integers(0, 3, 240), rng.integers(0, 2, 240)
    x = np.array([[6, 0, 0, 2], [0, 6, 0, 2], [0, 0, 6, 2]])[kind] + rng.normal(size=(240, 4)) * 0.5 + batch[:, None] * np.array([1.5, 1.5, -1.5, 2.0])
    df = spark.createDataFrame([(f"c{i:03d}", "ab"[batch[i]], [float(t) for t in x[i]]) for i in range(240)], "barcode string, batch string, vec array<double>")
    out = np.array([r["vec"] for r in harmony.correct(df, clusters=6, rounds=3, passes=3).orderBy("barcode").collect()])
    assert _mixing(out, batch) > max(0.3, 2 * _mixing(x, batch))
    assert _mixing(out, kind) < 0.1  # neighbours are still of one kind
    one = df.where("batch = 'a'")
    assert harmony.correct(one).count() == one.count() and harmony.correct(df.limit(0)).count() == 0


def test_stabilised_variance_equals_dense(spark):
    rng = np.random.default_rng(5)
    g, n = 80, 60
    y = rng.poisson(rng.gamma(2, rng.uniform(0.2, 20, g)[:, None] / 2, (g, n))).astype(float)
    y[7] *= 6
    counts = spark.createDataFrame([(f"g{i:02d}", f"c{j}", float(y[i, j])) for i in range(g) for j in range(n) if y[i, j]], "feature string, barcode string, value double")
    got = {r["feature"]: r for r in normalize.stabilised_features(counts, n, g).collect()}
    mean, var = y.mean(1), y.var(1, ddof=1)
    lx, ly = np.log10(mean), np.log10(var)
    # the same local quadratic at the same places, by least squares
    places = lx.min() + (lx.max() - lx.min()) * np.arange(normalize.KNOTS) / (normalize.KNOTS - 1)
    fit = []
    for p in places:
        u = (lx - p) / (normalize.SPAN * (lx.max() - lx.min()))
        w = np.where(abs(u) < 1, (1 - abs(u) ** 3) ** 3, 0)
        fit.append(np.polyfit(u, ly, 2, w=np.sqrt(w))[2])
    sd = np.sqrt(10 ** np.interp(lx, places, fit))
    z = np.minimum((y - mean[:, None]) / sd[:, None], np.sqrt(n))
    want = (z**2).sum(1) / (n - 1)
    assert np.allclose([got[f"g{i:02d}"]["variance"] for i in range(g)], want, rtol=1e-6)
    assert got["g07"]["rank"] <= 3


def test_counts_are_made_once(spark):
    """what embeddings and integration read again and again is not computed again."""
    from pyspark.sql import functions as F

    from mosaiq.operators import embed, integrate

    for name, run in (
        ("concat_embed", lambda c: integrate.concat_embed(c, c, dims=2, n_features=4)),
        ("embed", lambda c: embed.generate_embeddings(c, c.select("barcode").distinct(), "PCA", dims=2, n_features=4)),
        ("assays", lambda c: integrate.integrate_counts(c, c.withColumn("barcode", F.concat(F.lit("r"), "barcode")), 4, 2)),
        ("harmony", lambda c: integrate.integrate_counts(c, c.withColumn("barcode", F.concat(F.lit("r"), "barcode")), 4, 2, "HarmonyIntegration")),
    ):
        seen = spark.sparkContext.accumulator(0)

        def counted(frames, seen=seen):
            for f in frames:
                seen.add(len(f))
                yield f

        rows = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 5).alias("feature"), F.floor(F.col("id") / 5).cast("string").alias("barcode"), (F.xxhash64("id") % 50 + 60).cast("double").alias("value"))
        run(rows.mapInPandas(counted, rows.schema)).collect()
        assert seen.value <= {"concat_embed": 800, "embed": 600, "assays": 800, "harmony": 800}[name], (name, seen.value)
