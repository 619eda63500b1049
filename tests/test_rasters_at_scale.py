"""Tiles, borders, bubbles and territories do the same work whatever the number of cells."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import image, segment, spatial, territory


def raster(spark, wide, high, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(d, x + 1, y + 1, float(rng.random() + (x + y * d) / 9)) for d in (1, 2) for x in range(wide) for y in range(high)]
    return spark.createDataFrame(rows, "dim int, x int, y int, value double")


def values(df):
    return np.array([r[3] for r in sorted(df.select("dim", "x", "y", "value").collect())])


@pytest.mark.parametrize("tile", [4, 7])
@pytest.mark.parametrize("filter_", ["iso", "median", "box", "tv", "poisson"])
def test_filters_on_tiles_equal_the_whole_image(spark, filter_, tile):
    p = raster(spark, 21, 17)
    run = {
        "iso": lambda t: image.smooth(p, "iso", 2, [1, 0.5], across="mean", tile=t),
        "median": lambda t: image.smooth(p, "median", 2, box=[3, 5], across="max", tile=t),
        "box": lambda t: image.smooth(p, "box", 1, box=5, tile=t),
        "tv": lambda t: image.regularise(p, 1, 5, t),
        "poisson": lambda t: image.screened_poisson(p, 40.0, t),
    }[filter_]
    assert np.abs(values(run(tile)) - values(run(None))).max() < 1e-9


def test_poisson_halo_reaches_far_enough(spark):
    """A weight whose halo (53 pixels) is less than the image."""
    p = raster(spark, 150, 6)
    assert np.abs(values(image.screened_poisson(p, 0.33, 20)) - values(image.screened_poisson(p, 0.33))).max() < 1e-9


def test_denoising_in_rounds_equals_one(spark, monkeypatch):
    p = raster(spark, 15, 12)
    want = values(image.regularise(p, 1, 10))
    monkeypatch.setattr(image, "STEPS", 4)
    assert np.abs(values(image.regularise(p, 1, 10, 5)) - want).max() < 1e-9


def test_filters_of_no_pixels(spark):
    p = raster(spark, 2, 2).where("x < 0")
    assert image.smooth(p, "iso").count() == image.regularise(p).count() == image.screened_poisson(p).count() == 0


def rings(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["territory"], r["ring"], r["step"])):
        out[r["territory"], r["ring"]].append((r["x"], r["y"]))
    return out


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_borders_are_closed_rings_with_the_pixels_area(spark):
    rng = np.random.default_rng(3)
    rows = [(str(rng.integers(3)), x, y) for x in range(20) for y in range(20)]
    found = rings(territory.borders(spark.createDataFrame(rows, "territory string, x int, y int")))
    for ring in found.values():
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    for t in "012":
        assert sum(area(r) for (own, _), r in found.items() if own == t) == sum(r[0] == t for r in rows)


def test_borders_by_hand(spark):
    """A ring of eight pixels has a border outside and one around its hole; two pixels that touch at a corner have two."""
    eight = [("a", x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    found = rings(territory.borders(spark.createDataFrame([*eight, *eight[:2], ("b", 7, 7), ("b", 8, 8)], "territory string, x int, y int")))
    assert {k: (len(v), area(v)) for k, v in found.items()} == {("a", "0,0,0"): (12, 9.0), ("a", "1,1,1"): (4, -1.0), ("b", "7,7,0"): (4, 1.0), ("b", "8,8,0"): (4, 1.0)}
    assert found["b", "7,7,0"] == [(7, 7), (8, 7), (8, 8), (7, 8)]
    assert territory.borders(spark.createDataFrame([], "territory string, x int, y int")).count() == 0


def points(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"c{i:06}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((n, 2)))], "barcode string, x double, y double")


def test_bubbles_are_apart_and_reach_all(spark):
    cells = points(spark, 800).union(spark.createDataFrame([("far", 9.0, 9.0), ("same1", 0.5, 0.5), ("same2", 0.5, 0.5)], points(spark, 1).schema)).withColumn("extra", F.lit(1))
    at = np.array([(r["x"], r["y"]) for r in cells.collect()])
    c = np.array([(r["x"], r["y"]) for r in spatial.spread(cells, 0.1).collect()])
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) + np.eye(len(c))
    assert d.min() > 0.1
    assert np.sqrt(((at[:, None] - c[None]) ** 2).sum(axis=2)).min(axis=1).max() <= 0.1
    assert spatial.spread(cells.where("false"), 0.1).count() == 0
    assert 15 <= len(segment.initial_cells(points(spark, 800), 20)) <= 25


def brute(cells, radius):
    """Components by flood fill over all pairs."""
    todo, out = dict(cells), {}
    while todo:
        first = min(todo)
        part, front = {first}, [todo.pop(first)]
        while front:
            x, y, s = front.pop()
            for b in [b for b, (x2, y2, s2) in todo.items() if s2 == s and ((x - x2) ** 2 + (y - y2) ** 2) ** 0.5 <= radius]:
                part.add(b)
                front.append(todo.pop(b))
        out |= dict.fromkeys(part, min(part))
    return out


@pytest.mark.parametrize("leaf", [1, 256])
def test_territories_equal_flood_fill(spark, leaf, monkeypatch):
    monkeypatch.setattr(territory, "LEAF", leaf)
    rng = np.random.default_rng(8)
    # clumps at distances near the radius, copies of positions among them
    rows = [(f"c{i:04}", float(x + 0.1 * gx + rng.choice([0, 0.004])), float(y), "ab"[i % 2]) for i, (x, y, gx) in enumerate(zip(rng.random(300) / 20, rng.random(300), rng.integers(0, 4, 300), strict=True))]
    rows += [(f"d{i}", 0.77, 0.5, "a") for i in range(20)] + [("e", 0.8, 0.55, "a")]
    cells = spark.createDataFrame(rows, "barcode string, x double, y double, segment string")
    got = dict(territory._linked(cells, 0.052).collect())
    assert got == brute({r[0]: r[1:] for r in rows}, 0.052)


def test_positions_compared_grow_with_the_cells(spark):
    """Two fields whose gap is just over the radius, at four times the density each time."""
    done = []
    for n in (2_000, 8_000, 32_000):
        f = points(spark, n).select("barcode", (F.col("x") + F.when(F.col("x") > 0.5, 0.0501).otherwise(0)).alias("x"), "y", F.lit("s").alias("segment"))
        radius, work = 0.05, []
        side = radius / 32**0.5 * (1 - 1e-9)
        fine = [F.floor(F.col("x") / side).alias("fx"), F.floor(F.col("y") / side).alias("fy")]
        boxes = f.select("segment", *fine).distinct()
        step = F.sequence(F.lit(-6), F.lit(6))
        pairs = boxes.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where(f"fx * {side} < 0.5 and (fx + dx + 1) * {side} > 0.5501")
        pairs = pairs.select("segment", "fx", "fy", (F.col("fx") + F.col("dx")).alias("ox"), (F.col("fy") + F.col("dy")).alias("oy"), F.lit("l").alias("ca"), F.lit("r").alias("cb"))
        left, right = f.where("x < 0.52").toPandas(), f.where("x > 0.52").toPandas()
        near = np.abs(left["x"].to_numpy()[:, None] - right["x"].to_numpy()[None]) <= radius
        assert territory.reached(pairs, f.select("segment", "x", "y"), radius, side, work).count() == int(near.any())
        done.append(sum(work))
    assert done[-1] <= 16 * max(done[0], 1_000)
