from __future__ import annotations

import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.assay import SpatialAssay, trial_name
from mosaiq.operators import image, mapping, markers, metrics, normalize, segment, spatial, territory, tiling, views
from mosaiq.sources import read_coordinates, read_counts


def grid(spark, n=16, step=0.5):
    return spark.createDataFrame([(f"barcode{i * n + j + 1}", 1 + i * step, 1 + j * step) for i in range(n) for j in range(n)], "barcode string, x double, y double")


def test_resolution_fixtures(spark):
    g = grid(spark)
    out = tiling.reduce_resolution(g, 0.75)
    assert out.count() == 36
    names = {m for r in tiling.split_barcodes(out).collect() for m in [r["member"]]}
    assert names == {r["barcode"] for r in g.collect()}
    with pytest.warns(UserWarning):
        tiling.check_resolution(256, tiling.reduce_resolution(g, 0.5).count())
    with pytest.raises(ValueError):
        tiling.check_resolution(256, tiling.reduce_resolution(g, 1e-6).count())


def test_tiles_have_one_origin_for_each_cell(spark):
    t = tiling.generate_tiles(grid(spark, 6, 3.0), 1, 1, 1)
    s = t.agg(F.countDistinct("barcode").alias("n"), F.sum("origin").alias("o"), F.min("x").alias("x"), F.min("y").alias("y")).first()
    assert s["n"] == s["o"] == 36 and s["x"] > 0 and s["y"] > 0


def test_voronoi_areas_fill_the_frame(spark):
    v = tiling.voronoi(grid(spark, 5, 2.0))
    assert v.agg(F.sum("area")).first()[0] == pytest.approx((8 + 2) ** 2)
    assert v.agg(F.min(F.size("neighbors"))).first()[0] >= 2


def test_knn_equals_brute_force(spark):
    random.seed(1)
    pts = [(f"b{i}", random.choice([0.0, 50.0]) + random.random() * 3, random.random() * 100) for i in range(120)] + [("dup", 1.0, 1.0), ("dup2", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "barcode string, x double, y double")
    got = {}
    for r in spatial.knn_join(df, df, 7).collect():
        got.setdefault(r["center"], []).append((r["rank"], r["neighbor"]))
    for b, x, y in pts:
        want = [n for _, n in sorted((((x - p) ** 2 + (y - q) ** 2) ** 0.5, n) for n, p, q in pts)[:7]]
        assert [n for _, n in sorted(got[b])] == want
    assert spatial.knn_join(df, df.limit(0), 3).count() == 0


def test_components_of_the_chain(spark):
    df = spark.createDataFrame([(str(i), x, 0.0) for i, x in enumerate([0.0, 1.0, 2.0, 10.0, 11.0])], "barcode string, x double, y double")
    near = spatial.radius_join(df, df, 1.0).select(F.col("center").alias("a"), F.col("neighbor").alias("b"))
    assert {(r["barcode"], r["component"]) for r in spatial.components(near, df).collect()} == {("0", "0"), ("1", "0"), ("2", "0"), ("3", "3"), ("4", "3")}


def test_morphology(spark):
    one = spark.createDataFrame([(5, 5)], "x int, y int")
    grown = territory.dilate(one, 3)
    assert grown.count() == 9
    assert [tuple(r) for r in territory.erode(grown, 3).collect()] == [(5, 5)]


def test_layers_and_their_depth(spark):
    rows = [(f"c{i}_{j}", i, j, 1) for i in range(1, 8) for j in range(1, 8)]
    tiles = spark.createDataFrame(rows, "barcode string, x int, y int, origin int")
    cells = tiles.select("barcode", F.lit("1").alias("territory"))
    n = {r["layer"]: r["count"] for r in territory.layers(cells, tiles, ["1"]).groupBy("layer").count().collect()}
    assert n == {"1": 24, "2": 16, "3": 8, "4": 1}
    assert {r["layer"] for r in territory.layers(cells, tiles, ["1"], depth=2).collect()} == {"1", "2"}
    with pytest.warns(UserWarning):
        territory.layers(cells, tiles, ["1"], depth=42)
    with pytest.raises(ValueError):
        territory.layers(cells, tiles, ["9"])


def test_min_max_keeps_a_constant(spark):
    v = spark.createDataFrame([("a", [5.0, 1.0]), ("b", [5.0, 3.0])], "barcode string, vec array<double>")
    got = {(r["barcode"], r["dim"]): r["value"] for r in normalize.norm_dims(v).collect()}
    assert got == {("a", 1): 5.0, ("b", 1): 5.0, ("a", 2): 0.0, ("b", 2): 1.0}


def test_pearson_approximation(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "barcode string, vec array<double>")
    assert mapping.similarity(v, v, "pearson").first()["score"] == pytest.approx(0.66667)
    assert mapping.similarity(v, v, "pearson_exact").first()["score"] == pytest.approx(1.0)


def test_multiset_jaccard(spark):
    c = spark.createDataFrame([("q", "A", 2, 3), ("q", "B", 1, 3)], "barcode string, label string, n long, size long")
    s = spark.createDataFrame([("s", "A", 1, 3), ("s", "B", 2, 3)], "barcode string, label string, n long, size long")
    assert mapping.composition_jaccard(c, s).first()["score"] == 0.5


def test_filter_cost_errors_when_none_is_left(spark):
    c = spark.createDataFrame([("f", "q", "s", 0.5)], "kind string, query string, seed string, score double")
    with pytest.raises(ValueError):
        mapping.filter_cost(c, 1.0)
    with pytest.raises(ValueError):
        mapping.total_cost(c, ["funky"])


def test_rank_sum_equals_brute_force(spark):
    random.seed(2)
    cells = [(str(i), "a" if i < 12 else "b") for i in range(30)]
    cnt = [("g", str(i), float(random.randint(1, 4))) for i in range(30) if random.random() < 0.6]
    c = spark.createDataFrame(cnt, "feature string, barcode string, value double")
    g = markers.groups(spark.createDataFrame(cells, "barcode string, territory string"), ["a"], ["b"])
    r = markers.rank_sum(c, g, markers.metrics(c, g)).first()
    val = {b: v for _, b, v in cnt}
    a, b = ([val.get(i, 0.0) for i, t in cells if t == s] for s in "ab")
    assert r["w"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_markers_reject_unknown_methods(spark):
    with pytest.raises(ValueError):
        markers.identify_markers(None, None, method="funky")


def test_smoothing_and_regularising(spark):
    p = spark.createDataFrame([(1, x, y, float((x * 7 + y * 3) % 5)) for x in range(1, 9) for y in range(1, 7)], "dim int, x int, y int, value double")
    r = image.regularise(p, 1, 10).agg(F.min("value"), F.max("value")).first()
    assert r[0] == 0 and r[1] == 1
    for m in ("iso", "median", "box"):
        assert image.smooth(p, m, 2, box=3).count() == 48
    with pytest.raises(ValueError):
        image.smooth(p, "funky")
    with pytest.raises(ValueError):
        image.regularise(p, 0)


def test_views(spark):
    c = spark.createDataFrame([("a", 1.0, 1.0, "1"), ("b", 2.0, 1.0, "10"), ("c", 1.0, 2.0, "2"), ("d", 2.0, 2.0, "isolated")], "barcode string, x double, y double, territory string")
    assert [r["label"] for r in views.order_labels(c.select(F.col("territory").alias("label"))).orderBy("rank").collect()] == ["1", "2", "10", "isolated"]
    v = c.select("barcode", F.lit(1).alias("dim"), F.col("x").alias("value"))
    for dims in ([1, 2], [1, 2, 3, 4]):
        with pytest.raises(ValueError):
            views.image_plot(v, c, dims)
    k = spark.createDataFrame([("g", "a", 2.0)], "feature string, barcode string, value double")
    with pytest.warns(UserWarning):
        assert views.gene_expression(k, c, ["g", "lost"]).count() == 4


def test_linkage():
    import numpy as np

    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.95, 0.85], [0.9, 0.95, 0, 0.2], [0.8, 0.85, 0.2, 0]])
    assert metrics.complete_linkage(d, 0.5) == [0, 0, 1, 1]
    assert len(set(metrics.complete_linkage(d, 0, 3))) == 3


def test_assay(spark):
    g = grid(spark, 6, 1.0)
    counts = spark.createDataFrame([("f1", "barcode1", 2.0), ("f2", "barcode2", 1.0), ("f1", "other", 1.0)], "feature string, barcode string, value double")
    a = SpatialAssay.build(g, counts, scale=15)
    assert a.meta == {"scale": 15.0, "unit": "um"}
    assert a.cells.count() == 2 and a.get_counts("raw").count() == 2
    assert len(a.summary()) == 4
    assert trial_name(["Segment"], "Segment") == "Segment.1"
    with pytest.raises(ValueError):
        SpatialAssay.build(g, counts.where("barcode = 'other'"))
    with pytest.raises(TypeError):
        SpatialAssay.build("coordinates")
    with pytest.raises(ValueError):
        SpatialAssay.build(g, scale=1).add_counts(counts)
    b = SpatialAssay.build(g, scale=1).add_counts(counts, add_name="my_counts", force=True)
    assert list(b.counts) == ["my_counts", "raw_my_counts"] and b.active_counts == "my_counts"
    with pytest.raises(ValueError):
        a.add_cells(g.select("barcode"))
    labelled = a.add_cells(spark.createDataFrame([("barcode1", "A")], "barcode string, label string"))
    assert {r["label"] for r in labelled.trial().collect()} == {"A", "Undefined"}
    with pytest.raises(ValueError):
        a.trial()
    assert [n for n, _ in a.search_log("unit")] == ["spatial_omics_build"]
    with pytest.raises(ValueError):
        territory.isolate(g)
    t = SpatialAssay.build(g, scale=1).with_tiles(1, 1, 1)
    with pytest.warns(UserWarning):
        t.with_tiles()


def test_readers(spark):
    with pytest.raises(ValueError):
        read_coordinates(spark.createDataFrame([(1, 2)], "a int, b int"))
    wide = spark.createDataFrame([("g", 1, 0), ("h", 2, 3)], "feature string, c1 int, c2 int")
    assert {tuple(r) for r in read_counts(wide).collect()} == {("g", "c1", 1.0), ("h", "c1", 2.0), ("h", "c2", 3.0)}


def test_kmeans_gives_the_asked_number(spark):
    v = spark.createDataFrame([(i, [float(i % 10) * 10, random.random()]) for i in range(200)], "barcode long, vec array<double>")
    assert segment.kmeans(v, 10).select("segment").distinct().count() == 10
    with pytest.raises(ValueError):
        segment.segment_image(v, None, "funky")
    with pytest.raises(ValueError):
        segment.segment_image(v, None, dims=[3])


def test_count_stream(spark, tmp_path):
    from mosaiq.streaming import count_stream

    spark.createDataFrame([("f", "a", 1.0), ("f", "a", 2.0)], "feature string, barcode string, value double").write.parquet(f"{tmp_path}/in")
    q = count_stream(spark, f"{tmp_path}/in").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("sums").collect()] == [("f", "a", 3.0)]
    finally:
        q.stop()


def test_no_warning_for_known_genes(spark):
    c = spark.createDataFrame([("a", 1.0, 1.0, "1")], "barcode string, x double, y double, territory string")
    k = spark.createDataFrame([("g", "a", 2.0)], "feature string, barcode string, value double")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert views.gene_expression(k, c, ["g"], norm=False).first()["value"] == 2.0


@pytest.mark.parametrize("kinds", [("feature", "niche", "composition"), ("composition", "cell_type")])
def test_map_assays_equals_dense_brute_force(spark, kinds):
    import itertools
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(4)
    n, names = 6, ["f", "g", "h", "i"]
    side = {}
    for s in "sq":
        xy, v = rng.random((n, 2)) * 9, rng.integers(0, 9, (n, len(names))).astype(float)
        kind = [("A", "B", "C")[i % 3] for i in range(n)]
        cells = spark.createDataFrame([(f"{s}{i}", *map(float, xy[i]), kind[i]) for i in range(n)], "barcode string, x double, y double, cell_type string")
        counts = spark.createDataFrame([(f, f"{s}{i}", float(v[i, j])) for i in range(n) for j, f in enumerate(names) if v[i, j]], "feature string, barcode string, value double")
        near = np.argsort(((xy[:, None] - xy[None]) ** 2).sum(axis=2), axis=1)[:, :2]
        side[s] = cells, counts, v, v[near].mean(axis=1), [Counter(kind[j] for j in r) for r in near], kind
    (qc, qk, qv, qn, qm, qt), (sc, sk, sv, sn, sm, st) = side["q"], side["s"]
    r = lambda a, b: np.corrcoef(a, b)[0, 1] * (len(names) - 1) / len(names)
    score = {
        "feature": lambda i, j: r(qv[i], sv[j]),
        "niche": lambda i, j: r(qn[i], sn[j]),
        "composition": lambda i, j: (qm[i] & sm[j]).total() / (qm[i] | sm[j]).total(),
        "cell_type": lambda i, j: float(qt[i] == st[j]),
    }
    dense = {k: np.array([[score[k](i, j) for j in range(n)] for i in range(n)]) for k in kinds}
    assert (dense["composition"] == 0).any() and all((d.max(axis=1) > 0).all() for d in dense.values())
    cost = sum(1 - d for d in dense.values())
    least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    found = mapping.map_assays(sc, sk, qc, qk, kinds, k=2, threshold=0.0)[0].collect()
    assert len(found) == n
    assert all(m["cost"] == pytest.approx(cost[int(m["from"][1:]), int(m["to"][1:])], abs=1e-3) for m in found)
    assert sum(m["cost"] for m in found) == pytest.approx(least, abs=1e-3)


def test_cost_by_epoch_of_assigned_epochs(spark):
    """Epochs of assign_cells over all seeds, against plain Python."""
    import numpy as np

    rng = np.random.default_rng(5)
    score = rng.random((8, 8)).round(3)
    cost = spark.createDataFrame([(f"q{i}", f"s{j}", float(score[i, j])) for i in range(8) for j in range(8)], "query string, seed string, cost double")
    matches = mapping.epoch_matches(cost, 4, 4).cache()
    rows = matches.collect()
    assert all(m["cost"] == score[int(m["from"][1:]), int(m["to"][1:])] for m in rows)
    assert {m["to"] for m in rows} == {f"s{j}" for j in range(8)}
    best, want = {}, {}
    for e in range(1, 5):
        now = [m for m in rows if m["epoch"] == e]
        assert {m["from"] for m in now} == {f"q{i}" for i in range(8)}
        for m in now:
            best[m["from"]] = min(m["cost"], best.get(m["from"], 9.0))
        want[e] = sum(best.values()) / 8
    got = {r["epoch"]: r["cost"] for r in mapping.cost_by_epoch(matches).collect()}
    assert got == pytest.approx(want) and want[4] < want[1]
    assert {r["from"]: r["cost"] for r in mapping.assign_cells(cost, 4, 4).collect()} == best


def test_mapped_assay(spark):
    g = grid(spark, 4, 1.0)
    counts = spark.createDataFrame([("f", f"barcode{i}", float(i)) for i in range(1, 17)], "feature string, barcode string, value double")
    a, b = SpatialAssay.build(g, counts, scale=1), SpatialAssay.build(g, counts, name="query", scale=1)
    m = spark.createDataFrame([("barcode1", "barcode2", 1, 0.1), ("barcode3", "barcode2", 1, 0.2)], "`from` string, `to` string, epoch int, cost double")
    out = b.mapped_on(a, m)
    assert {(r["barcode"], r["x"], r["y"]) for r in out.get_coordinates(True).collect()} == {("barcode1", 1.0, 2.0), ("barcode3", 1.0, 2.0)}
    assert out.mapping_scores().count() == 2 and out.get_counts().count() == 2
    assert out.describe()["mapped"] and out.name == "mapped_query"
    with pytest.raises(ValueError):
        a.mapping_scores()


def test_regions_are_exact_where_density_is_uneven(spark):
    """A cluster of many cells beside few far ones: each point of the frame's inside is in the region of its
    nearest cell, and neighbours are mutual."""
    import random

    rng = random.Random(3)
    points = [(f"c{i}", rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for i in range(90)] + [(f"f{i}", rng.uniform(-40, 40), rng.uniform(-40, 40)) for i in range(12)]
    got = {r["barcode"]: r for r in tiling.voronoi(spark.createDataFrame(points, "barcode string, x double, y double"), 8).collect()}
    assert set(got) == {p[0] for p in points}

    def inside(poly, x, y):
        side = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for a, b in zip(poly, [*poly[1:], poly[0]], strict=True)]
        return all(s >= -1e-9 for s in side) or all(s <= 1e-9 for s in side)

    for _ in range(400):
        x, y = (rng.gauss(0, 1), rng.gauss(0, 1)) if rng.random() < 0.5 else (rng.uniform(-38, 38), rng.uniform(-38, 38))
        if not (min(p[1] for p in points) <= x <= max(p[1] for p in points) and min(p[2] for p in points) <= y <= max(p[2] for p in points)):
            continue
        name = min(points, key=lambda p: (p[1] - x) ** 2 + (p[2] - y) ** 2)[0]
        assert inside(got[name]["poly"], x, y)
    assert all(b in got[n]["neighbors"] for b, r in got.items() for n in r["neighbors"])
    dropped = tiling.filter_tiles(tiling.voronoi(spark.createDataFrame(points, "barcode string, x double, y double"), 8), 0.9).collect()
    left = {r["barcode"] for r in dropped}
    assert len(left) < len(points) and all(set(r["neighbors"]) <= left for r in dropped)


def test_tiling_keeps_one_set_of_barcodes(spark):
    cells = spark.createDataFrame([(f"b{i}-1", float(i % 16), float(i // 16)) for i in range(256)], "barcode string, x double, y double")
    counts = cells.select(F.lit("f").alias("feature"), "barcode", F.lit(2.0).alias("value"))
    a = SpatialAssay.build(cells, counts, scale=1.0).add_trial("Cells", cells.select("barcode", F.lit("A").alias("label")))
    a = a.add_embeddings(cells.select("barcode", F.array(F.lit(0.0)).alias("vec"))).with_tiles(0.5, 1, 1)
    names = {r[0] for r in a.cells.select("barcode").collect()}
    assert names == {r[0] for r in a.tiles.select("barcode").distinct().collect()} == {r[0] for r in a.get_counts().select("barcode").distinct().collect()}
    assert names == {r[0] for r in a.trial().select("barcode").collect()} and any("_et_" in n for n in names)
    assert {r[0] for r in a.active.select("barcode").collect()} <= names
    assert a.get_coordinates(original=True).where("x is null or y is null").count() == 0


def test_scores_of_barcodes_that_end_in_a_number(spark):
    cells = spark.createDataFrame([("ACGT-1", 1.0, 1.0), ("TTTT-1", 2.0, 3.0), ("AAAA-1", 5.0, 5.0)], "barcode string, x double, y double")
    counts = cells.select(F.lit("f").alias("feature"), "barcode", F.lit(2.0).alias("value"))
    a = SpatialAssay.build(cells, counts, scale=1.0)
    m = spark.createDataFrame([("ACGT-1", "TTTT-1", 1, 0.5), ("ACGT-1", "AAAA-1", 1, 0.7), ("TTTT-1", "AAAA-1", 1, 0.1)], "from string, to string, epoch int, cost double")
    got = {(r["barcode"], r["from"], r["to"], r["cost"]) for r in a.mapped_on(a, m).mapping_scores().collect()}
    assert got == {("ACGT-1", "ACGT-1", "TTTT-1", 0.5), ("ACGT-1-1", "ACGT-1", "AAAA-1", 0.7), ("TTTT-1", "TTTT-1", "AAAA-1", 0.1)}


@pytest.mark.parametrize("radius", [0.02, 0.05, 0.13])
def test_isolate_equals_brute_force(spark, radius):
    rng = np.random.default_rng(7)
    xy = np.round(rng.uniform(0, 12, (500, 2)) ** 1.3, 1)
    xy[::9] = xy[1::9][: len(xy[::9])]
    seg = [None if i % 50 == 0 else str(s) for i, s in enumerate(rng.integers(0, 3, 500))]
    rows = [(f"c{i:03d}", float(x), float(y), s) for i, ((x, y), s) in enumerate(zip(xy, seg, strict=True))]
    r = float(np.hypot(*(xy.max(0) - xy.min(0)))) * radius
    root = list(range(500))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(500):
        for j in range(i):
            if seg[i] is not None and seg[i] == seg[j] and float(np.hypot(*(xy[i] - xy[j]))) <= r:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    members = {}
    for i in range(500):
        members.setdefault(top(i), set()).add(rows[i][0])
    got = {}
    for x in territory.isolate(spark.createDataFrame(rows, "barcode string, x double, y double, segment string"), radius, 3).collect():
        got.setdefault(x["territory"], set()).add(x["barcode"])
    alone = got.pop("isolated", set())
    big = [members[k] for k in sorted(members) if len(members[k]) > 3]
    assert [got[str(k + 1)] for k in range(len(big))] == big and len(got) == len(big)
    assert len(alone) == sum(len(m) for m in members.values() if len(m) <= 3)


def test_batches_keep_the_hashed_order(spark):
    q = spark.range(2500).select(F.concat(F.lit("q"), "id").alias("query"))
    s = spark.range(900).select(F.concat(F.lit("s"), "id").alias("seed"))
    a, b, n = mapping.batches(q, s, 400, 2)
    order = [r["query"] for r in q.orderBy(F.xxhash64("query", F.lit(2)), "query").collect()]
    assert n == 7 and {r["query"]: r["batch"] for r in a.collect()} == {name: i // 400 for i, name in enumerate(order)}
    order = [r["seed"] for r in s.orderBy(F.xxhash64("seed", F.lit(2)), "seed").collect()]
    assert {(r["seed"], r["batch"]) for r in b.collect()} == {(order[p % 900], p // 400) for p in range(2800)}
