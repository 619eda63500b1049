"""Which layer a step works on, embeddings as mapping signal, and the filter of costs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.assay import SpatialAssay
from mosaiq.operators import mapping
from mosaiq.operators.normalize import log_norm


@pytest.fixture(scope="module")
def assay(spark):
    rng = np.random.default_rng(7)
    coords = spark.createDataFrame([(f"c{i:02d}", float(i % 8), float(i // 8)) for i in range(48)], "barcode string, x double, y double")
    counts = spark.createDataFrame([(f"g{g}", f"c{i:02d}", float(1 + rng.poisson(3 + 4 * (g < 3 and i < 24)))) for g in range(8) for i in range(48)], "feature string, barcode string, value double")
    a = SpatialAssay.build(coords, counts, scale=1.0)
    a = a.add_counts(log_norm(counts), counts, add_name="logs")
    labels = spark.createDataFrame([(f"c{i:02d}", "a" if i < 24 else "b") for i in range(48)], "barcode string, label string")
    return a.add_trial("Territory", labels)


def test_count_models_take_raw_counts(assay):
    raw = assay.counts["raw"].agg(F.sum("value")).first()[0]
    total = lambda df: df.agg(F.sum("value")).first()[0]
    for method in ("DESeq2", "QLF", "LRT"):
        assert total(assay.counts_for(method, "logs")) == raw
    assert total(assay.counts_for("wilcox", "logs")) != raw
    with pytest.raises(ValueError):
        assay.counts_for("wilcox", "nothing")
    found = assay.identify_markers(method="wilcox", norm_method="raw", pval=0.05)
    assert {r["genes"] for r in found.get_markers().collect()} >= {"g0", "g1", "g2"}


def test_other_layers_than_raw_are_embedded_as_they_are(assay):
    vec = lambda a: {r["barcode"]: r["vec"] for r in a.active.collect()}
    given = vec(assay.generate_embeddings("PCA", "log_norm", "logs", dims=2))
    direct = vec(assay.generate_embeddings("PCA", "TFIDF", "logs", dims=2))
    assert given == direct


def test_embeddings_as_mapping_signal(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 5))
    v = spark.createDataFrame([(f"q{i:02d}", [float(t) for t in x[i]]) for i in range(30)], "barcode string, vec array<double>")
    w = spark.createDataFrame([(f"s{i:02d}", [float(t) for t in x[i] + 0.01 * rng.normal(size=5)]) for i in range(30)], "barcode string, vec array<double>")
    cells = lambda p: spark.createDataFrame([(f"{p}{i:02d}", float(i % 6), float(i // 6)) for i in range(30)], "barcode string, x double, y double")
    found, costs = mapping.map_assays(cells("s"), w, cells("q"), v, ("feature",), signal="embeddings", threshold=0.0)
    pairs = {(r["from"], r["to"]) for r in found.collect()}
    assert len({q[1:] == s[1:] for q, s in pairs}) == 1 and len(pairs) == 30
    some = mapping.embedding_signal(v, [2, 4])
    assert {r[0] for r in some.select("feature").distinct().collect()} == {"dim_00002", "dim_00004"}


def test_filter_of_costs(spark):
    rows = [("feature", "q1", "s", 0.5), ("feature", "q2", "s", -0.1), ("feature", "q3", "s", 0.9), ("cell_type", "q1", "s", 1.0), ("cell_type", "q2", "s", 1.0)]
    costs = spark.createDataFrame(rows, "kind string, query string, seed string, score double")
    kept = lambda *a: {r["query"] for r in mapping.filter_cost(costs, *a).select("query").distinct().collect()}
    assert kept(0.3) == {"q1"} and kept(-0.5) == {"q1", "q2"}
    assert kept(-0.5, False) == {"q1", "q2", "q3"}  # a kind without a row counts as 0
    with pytest.raises(ValueError):
        kept(0.95)


def test_filtered_assay_keeps_cells_without_counts(spark):
    """a customer without orders is a cell whose counts are all zero."""
    c = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 3.0, 1.0)], "barcode string, x double, y double")
    k = spark.createDataFrame([("f", "a", 1.0), ("g", "c", 2.0)], "feature string, barcode string, value double")
    labels = c.selectExpr("barcode", "'t' as label")
    names = lambda a: {r["barcode"] for r in a.get_coordinates().collect()}
    whole = SpatialAssay.build(c, k, scale=1.0, sparse=True).add_trial("Territory", labels)
    assert names(whole.filtered(territories=["t"])) == {"a", "b", "c"}
    assert names(whole.filtered(cells=["a", "c"], genes=["f"])) == {"a", "c"}
    assert names(SpatialAssay.build(c, k, scale=1.0)) == {"a", "c"}
