"""Inverted lists against the exact join."""

from __future__ import annotations

import numpy as np

from mosaiq.operators import ann, spatial
from mosaiq.sources.bindings import latent_assay


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "barcode long, vec array<double>").cache()


def test_clustered_vectors_need_few_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "PACK", 40)  # several packs a list
    rng = np.random.default_rng(2)
    v = _frame(spark, rng.normal(size=(30, 8)).repeat(40, 0) * 4 + rng.normal(size=(1200, 8)))
    exact = spatial.nearest_vectors(v, v, 8)
    found = ann.nearest(v, v, 8)
    assert found.groupBy("center").count().where("count = 8").count() == 1200
    assert ann.recall(found, exact).first()["recall"] >= 0.95
    centres = ann.learn_centres(v)
    probes = ann.probes_for(v, ann._lists(v, centres, 1), centres, 8, 0.97, v)
    assert probes <= len(centres) / 5  # a fifth of all pairs at most


def test_embeddings_reach_the_target(spark):
    v = latent_assay(spark, "/root/testdata/sf0.001").select("barcode", "vec")
    exact = spatial.nearest_vectors(v, v, 10)
    assert ann.recall(ann.nearest(v, v, 10), exact).first()["recall"] >= 0.95


def test_all_lists_are_exact_and_odd_tables(spark):
    v = _frame(spark, [[0.0, 0.0]] * 5 + [[1.0, 0.0], [5.0, 5.0]])
    key = lambda df: sorted((r["center"], r["neighbor"], r["rank"]) for r in df.collect())
    assert key(ann.nearest(v, v, 3, probes=99)) == key(spatial.nearest_vectors(v, v, 3))
    assert ann.nearest(v, v.limit(0), 3).count() == 0 and ann.nearest(v.limit(0), v, 3).count() == 0
