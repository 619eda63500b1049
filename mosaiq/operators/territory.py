"""Territories: connected parts of segments, and their growth, erosion and layers."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .spatial import components


def isolate(cells: DataFrame, capture_radius: float = 0.05, min_size: int = 10, singles_isolated: bool = True) -> DataFrame:
    """cells (barcode, x, y, segment) with territory: components, within a segment, of cells at most
    capture_radius of the bounding box's diagonal apart, numbered over all segments; those of min_size
    cells or fewer are `isolated`.

    Cells of a segment in one square of side radius / sqrt 2 are always linked, so squares are the nodes, and
    two are linked by sixteenths of them that lie wholly within the radius. Only between parts that these links
    leave apart are positions compared, box by box (reached)."""
    if "segment" not in cells.columns:
        raise ValueError("segment the assay first")
    box = cells.agg(F.sqrt(F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("d")).first()["d"] or 0.0
    radius = max(box * capture_radius, 1e-9)
    found = _linked(cells.select("barcode", "x", "y", "segment"), radius)
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    big = sizes.where((F.col("n") > min_size) if singles_isolated else (F.col("n") > min_size) | (F.col("n") == 1))
    named = big.select("component", F.row_number().over(W.orderBy("component")).cast("string").alias("t"))
    return cells.join(found, "barcode").join(named, "component", "left").select(*cells.columns, F.coalesce("t", F.lit("isolated")).alias("territory"))


def _linked(cells: DataFrame, radius: float) -> DataFrame:
    """barcode, component (its smallest barcode) of cells of a segment at most radius apart, link by link.
    A null segment links with nothing."""
    side = radius / 32**0.5 * (1 - 1e-9)
    fine = [F.floor(F.col("x") / side).alias("fx"), F.floor(F.col("y") / side).alias("fy")]
    square = ["segment", F.floor(F.col("fx") / 4).alias("gx"), F.floor(F.col("fy") / 4).alias("gy")]
    placed = cells.where("segment is not null").select("barcode", "x", "y", "segment", *fine)
    node = cut(placed.select("barcode", *square).groupBy("segment", "gx", "gy").agg(F.min("barcode").alias("node")))
    spot = cut(placed.select("segment", "fx", "fy").distinct().select("fx", "fy", *square).join(node, ["segment", "gx", "gy"]).select("segment", "fx", "fy", "node"))
    step = F.sequence(F.lit(-6), F.lit(6))
    around = spot.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).where("dx > 0 or (dx = 0 and dy > 0)")
    around = around.where("pow(greatest(abs(dx) - 1, 0), 2) + pow(greatest(abs(dy) - 1, 0), 2) <= 32.1")
    other = spot.select("segment", F.col("fx").alias("ox"), F.col("fy").alias("oy"), F.col("node").alias("b"))
    near = around.withColumnsRenamed({"node": "a"}).withColumns({"ox": F.col("fx") + F.col("dx"), "oy": F.col("fy") + F.col("dy")}).join(other, ["segment", "ox", "oy"]).where("a <> b")
    near = near.select("segment", "fx", "fy", "ox", "oy", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr("pow(abs(dx) + 1, 2) + pow(abs(dy) + 1, 2) <= 32").alias("sure"))
    sure = cut(near.where("sure").select("a", "b").distinct())
    squares = cut(components(sure, node.select(F.col("node").alias("barcode"))).select(F.col("barcode").alias("node"), "component"))
    ends = [squares.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    open_ = near.where("not sure").join(sure, ["a", "b"], "left_anti").join(ends[0], "a").join(ends[1], "b").where("ca <> cb")
    open_ = cut(open_.select("segment", "fx", "fy", "ox", "oy", "ca", "cb"))
    if not open_.isEmpty():
        met = reached(open_, placed.select("segment", "x", "y").distinct(), radius, side).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        top = components(met.distinct(), squares.select(F.col("component").alias("barcode")).distinct())
        squares = squares.join(top.select(F.col("barcode").alias("component"), F.col("component").alias("top")), "component").select("node", F.col("top").alias("component"))
    by = placed.select("barcode", *square).join(node, ["segment", "gx", "gy"]).join(squares, "node").select("barcode", "component")
    return by.union(cells.where("segment is null").select("barcode", "barcode"))


#: Boxes of so few pairs of positions are compared position by position.
LEAF = 256


def reached(pairs: DataFrame, positions: DataFrame, radius: float, side: float, work: list | None = None) -> DataFrame:
    """ca, cb of pairs (segment, fx, fy, ox, oy, ca, cb: boxes of that side, and whose they are) with a position in each
    box at most radius apart. Boxes shrink to what they hold: pairs wholly within the radius are links, pairs
    wholly beyond it go, those of few positions are compared, and the rest is split into sixteenths, unless ca and cb are linked by then.
    work gets the number of positions compared in each round."""
    links, ratio = None, 1
    while True:
        at = ["segment", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")]
        boxes = positions.groupBy(*at).agg(F.count("*").alias("n"), *[f(c).alias(k + c) for c in "xy" for k, f in (("l", F.min), ("h", F.max))])
        boxes = cut(boxes.withColumns({"px": F.floor(F.col("bx") / ratio), "py": F.floor(F.col("by") / ratio)}))
        one = boxes.withColumnsRenamed({"px": "fx", "py": "fy"})
        two = boxes.select("segment", F.col("px").alias("ox"), F.col("py").alias("oy"), *[F.col(c).alias(f"{c}2") for c in ("bx", "by", "n", "lx", "hx", "ly", "hy")])
        met = pairs.join(one, ["segment", "fx", "fy"]).join(two, ["segment", "ox", "oy"])
        gap = [F.greatest(F.lit(0.0), F.col(f"l{c}2") - F.col(f"h{c}"), F.col(f"l{c}") - F.col(f"h{c}2")) for c in "xy"]
        span = [F.greatest(F.col(f"h{c}2") - F.col(f"l{c}"), F.col(f"h{c}") - F.col(f"l{c}2")) for c in "xy"]
        apart = lambda d: F.sqrt(F.pow(d[0], 2) + F.pow(d[1], 2))
        met = met.where(apart(gap) <= radius).select("segment", "bx", "by", "bx2", "by2", "ca", "cb", (F.col("n") * F.col("n2")).alias("n"), (apart(span) <= radius).alias("sure"))
        met = cut(met)
        sure = met.where("sure").select("ca", "cb").distinct()
        few = met.where(~F.col("sure") & (F.col("n") <= LEAF)).join(sure, ["ca", "cb"], "left_anti")
        if work is not None:
            work.append(few.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        first = positions.select(*at, "x", "y")
        second = positions.select(*at, F.col("x").alias("x2"), F.col("y").alias("y2")).withColumnsRenamed({"bx": "bx2", "by": "by2"})
        close = few.join(first, ["segment", "bx", "by"]).join(second, ["segment", "bx2", "by2"])
        close = close.where(F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2)) <= radius).select("ca", "cb")
        new = cut(sure.union(close).distinct())
        links = new if links is None else links.union(new)
        left = met.where(~F.col("sure") & (F.col("n") > LEAF)).join(new, ["ca", "cb"], "left_anti")
        pairs = cut(left.select("segment", F.col("bx").alias("fx"), F.col("by").alias("fy"), F.col("bx2").alias("ox"), F.col("by2").alias("oy"), "ca", "cb"))
        if pairs.isEmpty():
            return links
        held = pairs.select("segment", F.col("fx").alias("bx"), F.col("fy").alias("by")).union(pairs.select("segment", "ox", "oy")).distinct()
        positions = cut(positions.select("*", *at[1:]).join(held, ["segment", "bx", "by"], "left_semi").select("segment", "x", "y"))
        side, ratio = side / 4, 4


def globalise(df: DataFrame, order: str = "barcode") -> DataFrame:
    """Pairs of segment and trial renumbered by first appearance; isolated ones stay."""
    first = df.where("trial <> 'isolated'").groupBy("segment", "trial").agg(F.min(order).alias("f"))
    n = first.select("segment", "trial", F.dense_rank().over(W.orderBy("f", "segment", "trial")).cast("string").alias("n"))
    return df.join(n, ["segment", "trial"], "left").select(order, "segment", F.coalesce("n", F.lit("isolated")).alias("trial"))


def dilate(mask: DataFrame, k: int) -> DataFrame:
    """mask (x, y) grown by a square of k pixels."""
    lo, hi = -(k // 2), (k - 1) // 2
    step = F.sequence(F.lit(lo), F.lit(hi))
    return mask.select("x", "y").withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()


def erode(mask: DataFrame, k: int) -> DataFrame:
    """Pixels all of whose square of k pixels is in the mask."""
    lo, hi = -(k // 2), (k - 1) // 2
    step = F.sequence(F.lit(-hi), F.lit(-lo))
    hit = mask.select("x", "y").distinct().withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).groupBy((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(F.count("*").alias("n"))
    return hit.where(F.col("n") == k * k).select("x", "y")


def _chosen(cells: DataFrame, territory: list[str]) -> DataFrame:
    have = {r[0] for r in cells.where(F.col("territory").isin([str(t) for t in territory])).select("territory").distinct().collect()}
    if not have:
        raise ValueError("none of the territories is present")
    if len(have) < len(set(map(str, territory))):
        warnings.warn("some territories are not present", stacklevel=3)
    return cells.where(F.col("territory").isin(sorted(have)))


def morph(cells: DataFrame, tiles: DataFrame, territory: list[str], factors: list[int], strict: bool = False) -> DataFrame:
    """cells (barcode, territory) after growing (positive) and shrinking (negative factors) the union of
    the territories' pixels: barcodes whose origin falls inside get the smallest of the labels. With
    strict, barcodes that no longer are inside lose theirs (`isolated`)."""
    own = _chosen(cells, territory)
    label = min(territory, key=lambda t: (len(str(t)), str(t)))
    mask = tiles.join(own, "barcode", "left_semi").select("x", "y").distinct()
    for f in factors:
        mask = dilate(mask, f) if f > 0 else erode(mask, -f) if f < 0 else mask
    inside = tiles.where("origin = 1").join(mask, ["x", "y"], "left_semi").select("barcode").distinct().withColumn("__in", F.lit(True))
    out = F.when(F.col("__in"), F.lit(str(label)))
    if strict:
        out = out.when(F.col("territory").isin([str(t) for t in territory]), F.lit("isolated"))
    return cells.join(inside, "barcode", "left").select(*[c for c in cells.columns if c != "territory"], out.otherwise(F.col("territory")).alias("territory"))


def layers(cells: DataFrame, tiles: DataFrame, territory: list[str], depth: int | None = None, factors: list[int] | None = None) -> DataFrame:
    """barcode, layer: 1 for barcodes with a pixel on the border of the union of territories, 2 for those
    on the border of what is left, and so on; `out` elsewhere. depth gathers layers into that many."""
    if factors:
        cells = morph(cells, tiles, territory, factors)
        territory = [min(territory, key=lambda t: (len(str(t)), str(t)))]
    left = cut(tiles.join(_chosen(cells, territory), "barcode", "left_semi").select("barcode", "x", "y").distinct())
    found, k = None, 0
    step = F.sequence(F.lit(-1), F.lit(1))
    while not left.isEmpty():
        k += 1
        pix = left.select("x", "y").distinct()
        around = pix.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
        edge = left.join(around.where("n < 9").select("x", "y"), ["x", "y"], "left_semi").select("barcode").distinct().withColumn("n", F.lit(k))
        found = edge if found is None else found.union(edge)
        left = cut(left.join(edge, "barcode", "left_anti"))
        found = cut(found)
    if depth is not None and depth > k:
        warnings.warn(f"there are {k} layers, fewer than {depth}", stacklevel=2)
        depth = None
    n = F.col("n") if depth is None else F.ceil(F.col("n") * depth / k)
    return cells.select("barcode").join(found, "barcode", "left").select("barcode", F.coalesce(n.cast("string"), F.lit("out")).alias("layer"))


def dispatch(cells: DataFrame, first: list[str] | None = None, second: list[str] | None = None, selected: DataFrame | None = None) -> DataFrame:
    """cells with territory as it is for those named and `other` elsewhere (all as they are if none is
    named). With selected (barcode), only those barcodes keep a name, which is that of their side: the
    named territories joined by a space."""
    name = lambda ts: " ".join(map(str, ts))
    t = F.col("territory")
    one, two = (t.isin([str(x) for x in ts]) if ts else F.lit(False) for ts in (first, second))
    keep = (one | two) if first or second else F.lit(True)
    if selected is None:
        return cells.withColumn("territory", F.when(keep, t).otherwise(F.lit("other")))
    label = F.when(one, F.lit(name(first or []))).when(two, F.lit(name(second or []))).otherwise(t if not (first or second) else F.lit("other"))
    own = selected.select("barcode").distinct().withColumn("__own", F.lit(True))
    return cells.join(own, "barcode", "left").withColumn("territory", F.when(F.col("__own"), label).otherwise(F.lit("other"))).drop("__own")


def borders(mask: DataFrame) -> DataFrame:
    """territory, ring, step, x, y: the borders of territories of pixels (territory, x, y) as closed rings of unit edges,
    by their beginnings in pixel corners (pixel x, y reaches from x, y to x + 1, y + 1). A ring runs with its pixels on the left
    (holes turn the other way); pixels that touch at a corner alone have rings of their own. It is named by its least edge,
    `x,y,direction`, where it begins at step 0. Edges are ordered by pointers that double their reach each round, so
    a ring of n edges takes log2(n) joins, and no ring is gathered in a task."""
    pix = mask.select("territory", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    # direction, the neighbour across, where the edge begins, where it leads
    sides = [(0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("d", "nx", "ny", "ax", "ay", "bx", "by"), s, strict=True)]) for s in sides])
    at = pix.withColumn("s", F.explode(each))
    across = pix.select("territory", F.col("x").alias("ox"), F.col("y").alias("oy"))
    edge = at.withColumns({"ox": F.col("x") + F.col("s.nx"), "oy": F.col("y") + F.col("s.ny")}).join(across, ["territory", "ox", "oy"], "left_anti")
    edge = cut(edge.select("territory", "s.d", *[(F.col(c) + F.col(f"s.{e}{c}")).alias(f"{e}{c}") for e in "ab" for c in "xy"]))
    out = edge.select("territory", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("d").alias("to"))
    turn = F.struct(F.element_at(F.array(*[F.lit(v) for v in (1, 0, 3, 2)]), F.pmod(F.col("to") - F.col("d"), F.lit(4)) + 1).alias("turn"), "to")
    on = edge.join(out, ["territory", "bx", "by"]).groupBy("territory", "ax", "ay", "d", "bx", "by").agg(F.min(turn)["to"].alias("to"))
    here, next_ = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("d")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("to").alias("d"))
    rows = cut(on.select("territory", here.alias("e"), next_.alias("next"), F.struct(here.alias("e"), F.lit(0).cast("long").alias("far")).alias("best")))
    reach = 1
    while True:
        ahead = rows.select("territory", F.col("e").alias("next"), F.col("next").alias("after"), F.col("best").alias("b"))
        far = F.struct(F.col("b.e").alias("e"), (F.col("b.far") + F.lit(reach)).alias("far"))
        new = cut(rows.join(ahead, ["territory", "next"]).select("territory", "e", F.col("after").alias("next"), F.least("best", far).alias("best"), (F.col("b.e") < F.col("best.e")).alias("moved")))
        moved, reach = not new.where("moved").isEmpty(), reach * 2
        rows = new.select("territory", "e", "next", "best")
        if not moved:
            break
    length = rows.groupBy("territory", F.col("best.e").alias("lead")).agg(F.count("*").alias("n"))
    named = rows.withColumn("lead", F.col("best.e")).join(length, ["territory", "lead"])
    return named.select("territory", F.concat_ws(",", "lead.x", "lead.y", "lead.d").alias("ring"), F.pmod(F.col("n") - F.col("best.far"), F.col("n")).alias("step"), "e.x", "e.y")
