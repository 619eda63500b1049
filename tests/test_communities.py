"""Communities in supersteps against the same in memory, and against plain definitions."""

from __future__ import annotations

import random

import pytest

from mosaiq.operators import communities, metrics, segment


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(1)
    w = {}
    for i in range(160):
        for _ in range(5):
            j = rng.choice([x for x in range(i // 20 * 20, i // 20 * 20 + 20) if x != i]) if rng.random() < 0.75 else rng.randrange(160)
            if i != j:
                w[min(i, j), max(i, j)] = w.get((min(i, j), max(i, j)), 0) + 1.0
    return w


def quality(w, label, resolution=1.0):
    total = 2 * sum(w.values())
    tot = {}
    for (i, j), x in w.items():
        tot[label[i]] = tot.get(label[i], 0) + x
        tot[label[j]] = tot.get(label[j], 0) + x
    return 2 * sum(x for (i, j), x in w.items() if label[i] == label[j]) / total - resolution * sum(t * t for t in tot.values()) / total**2


@pytest.mark.parametrize("method", ["louvain", "leiden"])
def test_modularity_is_within_a_hundredth_of_the_one_in_memory(spark, graph, method):
    near = {i: {} for i in range(160)}
    for (i, j), x in graph.items():
        near[i][j] = near[j][i] = x
    want = quality(graph, segment.louvain(near, 1.0, method == "leiden"))
    edges = spark.createDataFrame([(i, j, x) for (i, j), x in graph.items()], "a long, b long, w double").cache()
    out = communities.find(edges, 1.0, method).cache()
    label = {r["node"]: r["label"] for r in out.collect()}
    assert label.keys() == near.keys()
    got = quality(graph, label)
    assert got >= 0.99 * want
    assert abs(communities.modularity(edges, out) - got) < 1e-9
    if method == "leiden":  # every community hangs together
        for c in set(label.values()):
            members = {n for n in label if label[n] == c}
            seen, stack = set(), [min(members)]
            while stack:
                u = stack.pop()
                if u not in seen:
                    seen.add(u)
                    stack += [x for x in near[u] if x in members]
            assert seen == members


def test_names_loops_and_nodes_without_edges(spark):
    rows = [(a, b, 1.0) for c in ("p", "q") for a in (f"{c}1", f"{c}2", f"{c}3") for b in (f"{c}2", f"{c}3", f"{c}4") if a < b] + [("p1", "q1", 0.1), ("p1", "p1", 2.0)]
    edges = spark.createDataFrame(rows, "a string, b string, w double")
    nodes = spark.createDataFrame([(f"{c}{i}",) for c in "pq" for i in range(1, 5)] + [("alone",)], "barcode string")
    label = {r["barcode"]: r["label"] for r in communities.named(edges, nodes).collect()}
    assert len({label[f"p{i}"] for i in range(1, 5)}) == len({label[f"q{i}"] for i in range(1, 5)}) == 1
    assert len({label["p1"], label["q1"], label["alone"]}) == 3
    with pytest.raises(ValueError):
        communities.find(edges, method="spectral")


def test_clusters_of_overlaps(spark):
    rows = [(f"{c}{i}", f"s{c}{j}", 1.0 - 0.01 * ((i + j) % 5)) for c in "xy" for i in range(4) for j in range(5)]
    scores = spark.createDataFrame(rows, "query string, seed string, score double")
    label = {r["query"]: r["cluster"] for r in metrics.clusters(scores, 4, method="louvain").collect()}
    assert len(label) == 8 and len({label[f"x{i}"] for i in range(4)}) == 1 and label["x0"] != label["y0"]
