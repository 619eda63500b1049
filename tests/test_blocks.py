"""Scores of all pairs, block by block, against numpy; what of them is shuffled."""

from __future__ import annotations

import numpy as np
import pytest

from mosaiq.operators import blocks, mapping, metrics


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    side = {}
    for name, n, first in (("q", 70, 0), ("s", 50, 1000)):
        v, xy = rng.normal(size=(n, 6)), rng.integers(0, 9, (n, 2)).astype(float)
        rows = [(first + i, [float(t) for t in v[i]], float(xy[i, 0]), float(xy[i, 1])) for i in range(n)]
        side[name] = spark.createDataFrame(rows, "barcode long, vec array<double>, x double, y double"), v, xy
    return side


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for k, n in (("FIRST", 16), ("SECOND", 12), ("PARTS", 3), ("HELD", 2), ("ROWS", 5)):
        monkeypatch.setattr(blocks, k, n)


def scores(sides, decimals=1):
    return blocks.Scores(sides["q"][0], sides["s"][0], {"feature": blocks.correlation(), "niche": blocks.closeness(5)}, decimals)


def matrices(sides, decimals=1):
    (_, a, p), (_, b, o) = sides["q"], sides["s"]
    near = np.exp(-np.sqrt(((p[:, None] - o[None]) ** 2).sum(2)) / 5)
    up = lambda x: np.trunc(x * 10**decimals + np.copysign(0.5, x)) / 10**decimals
    return {"feature": up(np.corrcoef(a, b)[: len(a), len(a) :]), "niche": up(near)}


def shuffled(df) -> int:
    """Rows that the plan's exchanges above the kernel wrote."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    out, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        if name == "ShuffleExchangeExec":
            out += p.metrics().apply("shuffleRecordsWritten").value()
        if name == "MapInArrowExec":
            continue
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return out


def test_contribution_of_all_pairs(sides):
    """F1: by how many pairs have each score; no pair is shuffled."""
    got = {r["metric"]: r for r in metrics.contribution(scores(sides)).collect()}
    want, listed = matrices(sides), {r["metric"]: r for r in metrics.contribution(scores(sides).table()).collect()}
    for k, m in want.items():
        x = np.sort(m.ravel())
        n = len(x)
        fine = {"dispersion": x.var(ddof=1) / x.mean(), "cv": x.std(ddof=1) / x.mean(), "gini": 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n, "iqr": np.subtract(*np.quantile(x, [0.75, 0.25])), "range": x[-1] - x[0], "poc": x.sum() / sum(w.sum() for w in want.values())}
        for c, v in fine.items():
            assert got[k][c] == pytest.approx(v) and listed[k][c] == pytest.approx(v)
    d = scores(sides).distribution()
    assert {(r["kind"], r["score"]): r["n"] for r in d.collect()} == {(k, v): n for k, m in want.items() for v, n in zip(*np.unique(m, return_counts=True), strict=True)}
    assert 0 < shuffled(d) < 70 * 50 * 2 / 3


def test_similarity_shuffles_no_pairs(sides, spark):
    got = mapping.similarity(sides["q"][0], sides["s"][0], "pearson_exact", 12)
    want = np.corrcoef(sides["q"][1], sides["s"][1])[:70, 70:]
    assert shuffled(got) == 0
    assert all(r["score"] == pytest.approx(want[r["query"], r["seed"] - 1000], abs=1e-9) for r in got.collect()) and got.count() == 3500


def test_best_of_all_pairs(sides):
    """ties at rounded costs go to the lesser seed; what leaves a task are its blocks' best rows."""
    d = scores(sides).best(1)
    want = matrices(sides)
    cost = np.round(2 - want["feature"] - want["niche"], 1)
    got = {r["query"]: r for r in d.collect()}
    assert len(got) == 70 and (cost == cost.min(axis=1, keepdims=True)).sum() > 70
    for i, r in got.items():
        j = cost[i].argmin()
        assert (r["seed"], r["cost"], r["feature"], r["niche"]) == (1000 + j, pytest.approx(cost[i, j]), pytest.approx(want["feature"][i, j]), pytest.approx(want["niche"][i, j]))
    assert 0 < shuffled(d) <= 70 * 5
    best = d.selectExpr("query as `from`", "seed as `to`", "1 as epoch", "cost", "feature", "niche")
    wide = mapping.score_matches(best.drop("feature", "niche"), mapping.listed(best, ["feature", "niche"], "from", "to"))
    assert {(r["from"], r["feature"], r["niche"]) for r in wide.collect()} == {(r["query"], r["feature"], r["niche"]) for r in got.values()}


def test_best_within_groups_of_seeds(sides):
    """F13"""
    s = sides["s"][0].selectExpr("*", "barcode % 3 as third")
    d = blocks.Scores(sides["q"][0], s, scores(sides).kinds, 1).best(1, "third")
    cost = np.round(2 - sum(matrices(sides).values()), 1)
    third = np.arange(1000, 1050) % 3
    got = {(r["query"], r["third"]): r for r in d.collect()}
    assert len(got) == 210
    for (i, t), r in got.items():
        at = np.flatnonzero(third == t)
        assert r["cost"] == pytest.approx(cost[i, at].min()) and r["seed"] == 1000 + at[cost[i, at].argmin()]
    assert 0 < shuffled(d) <= 210 * 5


def test_assignment_scores_pairs_of_a_batch_alone(sides):
    """the same matches as over a table of all pairs."""
    key = lambda d: {(r["from"], r["to"], r["epoch"], round(r["cost"], 9)) for r in d.collect()}
    lazy = mapping.assign_cells(scores(sides), 20, 2)
    assert key(lazy) == key(mapping.assign_cells(mapping.total_cost(scores(sides).table()), 20, 2))


def test_filter_and_total_of_scores(sides):
    """as over a table of all pairs, without a shuffle of pairs."""
    rows = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.select(*sorted(d.columns)).collect())
    s = scores(sides, 3)
    kept = mapping.filter_cost(s, 0.8)
    listed = mapping.filter_cost(s.table(), 0.8)
    assert rows(kept.table()) == rows(listed) and 0 < listed.count() < 7000
    assert shuffled(kept.table()) == shuffled(mapping.total_cost(s)) == 0
    assert rows(mapping.total_cost(s)) == rows(mapping.total_cost(s.table()))
    with pytest.raises(ValueError):
        mapping.filter_cost(s, 1.0)


def test_top_of_all_pairs(sides):
    """F22"""
    d = scores(sides).of(kinds=["feature"])
    m = matrices(sides)["feature"]
    want = {(i, 1000 + int(j)) for i in range(70) for j in np.argsort(-m[i], kind="stable")[:7]}
    assert {(r["query"], r["seed"]) for r in d.top(7).collect()} == want
    assert 0 < shuffled(d.top(7)) <= 70 * 5 * 7
    key = lambda x: {(r["a"], r["b"], round(r["distance"], 9)) for r in x.collect()}
    assert key(metrics.top_overlap(d, 7)) == key(metrics.top_overlap(d.table(), 7))


def test_sparse_kinds_of_all_pairs(spark):
    """Sets, compositions and labels against plain Python; no pair is shuffled."""
    from collections import Counter

    rng = np.random.default_rng(8)
    side = {}
    for name, n in (("q", 40), ("s", 30)):
        bags = [Counter(str(t) for t in rng.integers(0, 9, rng.integers(0, 4))) for _ in range(n)]
        types = [int(t) if t < 4 else None for t in rng.integers(0, 5, n)]
        rows = [(f"{name}{i:02d}", list(b), list(b.values()), float(b.total()), t) for i, (b, t) in enumerate(zip(bags, types, strict=True))]
        side[name] = spark.createDataFrame(rows, "barcode string, items array<string>, counts array<long>, size double, cell_type int"), bags, types
    (q, qb, qt), (s, sb, st) = side["q"], side["s"]
    kinds = {"set": blocks.common_items(), "bag": blocks.common_counts("items"), "type": blocks.same("cell_type")}
    x = blocks.Scores(q, s, kinds)
    pairs = [(i, j) for i in range(40) for j in range(30)]
    want = {("set", i, j): len(set(qb[i]) & set(sb[j])) / len(set(qb[i]) | set(sb[j])) for i, j in pairs if set(qb[i]) & set(sb[j])}
    want |= {("bag", i, j): (qb[i] & sb[j]).total() / (qb[i] | sb[j]).total() for i, j in pairs if qb[i] & sb[j]}
    want |= {("type", i, j): 1.0 for i, j in pairs if qt[i] is not None and qt[i] == st[j]}
    got = {(r["kind"], int(r["query"][1:]), int(r["seed"][1:])): r["score"] for r in x.table().collect()}
    assert got == pytest.approx(want)
    cost = {(r["query"], r["seed"]): r["cost"] for r in x.total().collect()}
    assert len(cost) == len({k[1:] for k in want}) < 1200
    assert all(c == pytest.approx(3 - sum(want.get((k, int(a[1:]), int(b[1:])), 0) for k in kinds)) for (a, b), c in cost.items())
    assert shuffled(x.total()) == shuffled(mapping.jaccard(q, s)) == 0


def test_nearest_vectors_keep_their_best(spark):
    """exact, with ties by name; a task returns k rows a query, however many blocks it has met."""
    from mosaiq.operators import ann, spatial

    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (90, 3)).astype(float) + 1000.0
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "barcode long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, int(j), r + 1) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d[i]))[:7])}
    got = spatial.nearest_vectors(v, v, 7)
    assert {(r["center"], r["neighbor"], r["rank"]) for r in got.collect()} == want
    assert 0 < shuffled(got) <= 90 * 7 * 5
    assert all(r["dist"] == d[r["center"], r["neighbor"]] for r in got.collect())


def test_lists_by_blocks_equal_lists_by_copies(spark, monkeypatch):
    """queries that probe many lists are not copied to each."""
    from mosaiq.operators import ann

    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(rng.normal(size=(120, 4)))], "barcode long, vec array<double>")
    key = lambda d: {(r["center"], r["neighbor"], r["rank"]) for r in d.collect()}
    copies = key(ann.nearest(v, v, 5, probes=4, n_lists=9))
    monkeypatch.setattr(ann, "COPIES", 0)
    monkeypatch.setattr(ann, "_packs", None)
    assert key(ann.nearest(v, v, 5, probes=4, n_lists=9)) == copies


def test_linkage_of_parts_equals_the_matrix(spark, monkeypatch):
    """many queries of the same seeds, and no matrix of all of them on the driver."""
    rng = np.random.default_rng(12)
    base = [rng.choice(14, 5, replace=False) for _ in range(25)]
    tops = [base[i % 25] if i < 40 else rng.choice(14, 5, replace=False) for i in range(60)]
    rows = [(i, int(s), float(9 - r)) for i, t in enumerate(tops) for r, s in enumerate(t)]
    scores = spark.createDataFrame(rows, "query long, seed long, score double")
    sets = [set(t.tolist()) for t in tops]
    d = np.array([[1 - len(a & b) / len(a | b) for b in sets] for a in sets])
    wants = {h: metrics.complete_linkage(d, h * (d.max() - d.min()) + d.min()) for h in (0.4, 0.75)}
    monkeypatch.setattr(metrics, "complete_linkage", None)
    for h, want in wants.items():
        got = {r["query"]: int(r["cluster"]) - 1 for r in metrics.clusters(scores, 5, h).collect()}
        assert [got[i] for i in range(60)] == want and 1 < len(set(want)) < 60


def test_label_matches_are_dealt_out(spark, monkeypatch):
    """F16: pairs of one label come from many tasks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mapping, "PAIRS", 50)
    c = spark.range(60).select(F.col("id").alias("barcode"), F.when(F.col("id") % 10 < 8, 1).when(F.col("id") % 10 == 8, 2).alias("cell_type"))
    got = mapping.cell_type_match(c, c)
    want = {(a, b) for a in range(60) for b in range(60) if (a % 10 < 8 and b % 10 < 8) or (a % 10 == b % 10 == 8)}
    assert {(r["query"], r["seed"]) for r in got.collect()} == want and got.count() == len(want)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(want) / 4
