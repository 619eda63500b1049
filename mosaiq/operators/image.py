"""Embedding dimensions as raster images: pixels (dim, x, y, value), filters on them, and back.

Filters over neighbourhoods run on tiles with halos, in numpy, so that no task holds an image; the box blur also as windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def to_pixels(values: DataFrame, tiles: DataFrame) -> DataFrame:
    """dim, x, y, value for the whole raster: values (barcode, dim, value) at their tiles' pixels, all
    other pixels the median over pixels of their dimension."""
    hit = tiles.join(values, "barcode").groupBy("dim", "x", "y").agg(F.min(F.struct("barcode", "value"))["value"].alias("value"))
    mid = tiles.join(values, "barcode").groupBy("dim").agg(F.percentile("value", 0.5).alias("mid"))
    box = tiles.agg(F.max("x").cast("int").alias("mx"), F.max("y").cast("int").alias("my"))
    grid = mid.crossJoin(F.broadcast(box)).withColumn("x", F.explode(F.sequence(F.lit(1), F.col("mx")))).withColumn("y", F.explode(F.sequence(F.lit(1), F.col("my"))))
    return grid.join(hit, ["dim", "x", "y"], "left").select("dim", "x", "y", F.coalesce("value", "mid").alias("value"))


def from_pixels(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """barcode, dim, value at each barcode's origin pixel."""
    return tiles.where("origin = 1").join(pixels, ["x", "y"]).select("barcode", "dim", "value")


def ecdf(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", F.cume_dist().over(W.partitionBy("dim").orderBy("value")))


def balance_simplest(pixels: DataFrame, sleft: float = 1, sright: float = 1) -> DataFrame:
    """The lowest sleft % and the highest sright % of each image clipped, then scaled to [0, 1]."""
    q = pixels.groupBy("dim").agg(F.percentile("value", sleft / 100).alias("lo"), F.percentile("value", 1 - sright / 100).alias("hi"))
    v = F.least(F.greatest("value", "lo"), "hi")
    return pixels.join(F.broadcast(q), "dim").select("dim", "x", "y", F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value")).alias("value"))


def equalize_piecewise(pixels: DataFrame, n: int = 1) -> DataFrame:
    """Piecewise linear map that sends the n inner quantiles of an image to even steps of [0, 1]."""
    ps = [i / (n + 1) for i in range(n + 2)]
    q = pixels.groupBy("dim").agg(F.percentile("value", ps).alias("q"))
    i = F.least(F.lit(n), F.greatest(F.lit(0), F.size(F.filter("q", lambda b: b <= F.col("value"))) - 1))
    lo, hi = F.element_at("q", i + 1), F.element_at("q", i + 2)
    return pixels.join(F.broadcast(q), "dim").select("dim", "x", "y", ((i + F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.0))) / (n + 1)).alias("value"))


def equalize_plateau(pixels: DataFrame, down: float = 10, up: float = 100, bins: int = 256) -> DataFrame:
    """Double plateau: histogram counts held between down and up, then their running share as value."""
    r = pixels.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0)) * bins)).cast("int")
    binned = pixels.join(F.broadcast(r), "dim").select("dim", "x", "y", b.alias("b"))
    h = binned.groupBy("dim", "b").agg(F.greatest(F.lit(down), F.least(F.lit(up), F.count("*"))).cast("double").alias("n"))
    w = W.partitionBy("dim").orderBy("b")
    share = h.select("dim", "b", (F.sum("n").over(w) / F.sum("n").over(W.partitionBy("dim"))).alias("value"))
    return binned.join(F.broadcast(share), ["dim", "b"]).select("dim", "x", "y", "value")


EQUALIZERS = ("ECDF", "BalanceSimplest", "EqualizePiecewise", "SPE", "EqualizeDP", "EqualizeADP")


def equalize(pixels: DataFrame, method: str = "BalanceSimplest", n: int = 1, sleft: float = 1, sright: float = 1, weight: float = 0.1, up: float = 100, down: float = 10) -> DataFrame:
    """Histogram methods by name. EqualizeADP takes its plateaus, as multiples of a bin's mean count, from
    `down` and `up` in per cent."""
    if method == "ECDF":
        return ecdf(pixels)
    if method == "BalanceSimplest":
        return balance_simplest(pixels, sleft, sright)
    if method == "EqualizePiecewise":
        return equalize_piecewise(pixels, n)
    if method == "SPE":
        return screened_poisson(pixels, weight)
    if method == "EqualizeDP":
        return equalize_plateau(pixels, down, up)
    if method == "EqualizeADP":
        mean = pixels.groupBy("dim").count().agg(F.max("count")).first()[0] / 256
        return equalize_plateau(pixels, down / 100 * mean, up / 100 * mean * 10)
    raise ValueError(f"unknown equalisation {method!r}: {', '.join(EQUALIZERS)}")


def box_blur(pixels: DataFrame, half: int) -> DataFrame:
    """Mean of the square of 2 half + 1 pixels, clipped at the image's border: two passes of windows."""
    row = W.partitionBy("dim", "y").orderBy("x").rangeBetween(-half, half)
    col = W.partitionBy("dim", "x").orderBy("y").rangeBetween(-half, half)
    return pixels.withColumn("value", F.avg("value").over(row)).withColumn("value", F.avg("value").over(col))


#: The side of a tile, without its halo.
TILE = 256


def _per_tile(pixels: DataFrame, kernel, halo: int, tile: int | None = None, also: tuple = ()) -> DataFrame:
    """dim, x, y, value of `kernel` on each tile with `halo` pixels around it, which it must not reach beyond: the tiles' values
    are those of the whole image. Images are full rasters from 1, 1. The kernel gets the value and the columns `also` as arrays; what
    isn't there is 0."""
    side = tile or TILE

    def run(f):
        import numpy as np

        tx, ty = int(f["tx"].iloc[0]), int(f["ty"].iloc[0])
        x0, y0 = max(1, tx * side + 1 - halo), max(1, ty * side + 1 - halo)
        x, y = f["x"].to_numpy(int) - x0, f["y"].to_numpy(int) - y0
        arrays = []
        for c in ("value", *also):
            a = np.zeros((int(x.max()) + 1, int(y.max()) + 1))
            a[x, y] = f[c]
            arrays.append(a)
        own = ((x + x0 - 1) // side == tx) & ((y + y0 - 1) // side == ty)
        if not own.any():
            return f.loc[own, ["dim", "x", "y", "value", *also]]
        return f.loc[own, ["dim", "x", "y", "value", *also]].assign(value=kernel(*arrays)[x[own], y[own]])

    def tiles(c: str) -> Column:
        lo, hi = F.floor((F.col(c) - 1 - halo) / side), F.floor((F.col(c) - 1 + halo) / side)
        return F.explode(F.sequence(F.greatest(F.lit(0), lo).cast("int"), hi.cast("int")))

    cast = pixels.select("dim", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "value", *also)
    cast = cast.withColumn("tx", tiles("x")).withColumn("ty", tiles("y"))
    return cast.groupBy("dim", "tx", "ty").applyInPandas(run, "dim int, x int, y int, value double" + "".join(f", {c} double" for c in also))


def _to_unit(pixels: DataFrame) -> DataFrame:
    """Each image scaled to [0, 1]; constant ones stay."""
    pixels = cut(pixels)
    r = pixels.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("value"))
    return pixels.join(F.broadcast(r), "dim").select("dim", "x", "y", v.alias("value"))


def smooth(pixels: DataFrame, method: str = "iso", iterations: int = 1, sigma: float | list = 1, box: int | list = 20, across: str = "min", threshold: float = 0, tile: int | None = None) -> DataFrame:
    """iso (Gaussian of sigma), median (differences above threshold only) or box (mean) blur; several
    sizes are joined by min, max or mean; even iterations work on the image turned by 180 degrees."""
    import numpy as np

    if method not in ("iso", "median", "box"):
        raise ValueError(f"unknown smoothing {method!r}: iso, median, box")
    if across not in ("min", "max", "mean"):
        raise ValueError(f"unknown level {across!r}: min, max, mean")
    sizes = sigma if method == "iso" else box
    sizes = list(sizes) if isinstance(sizes, (list, tuple)) else [sizes]
    join = {"min": np.min, "max": np.max, "mean": np.mean}[across]

    def one(a, s):
        if method == "iso":
            n = max(1, int(np.ceil(3 * s)))
            k = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * s * s))
            k /= k.sum()
            for axis in (0, 1):
                p = np.pad(a, [(n, n) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
                a = np.apply_along_axis(np.convolve, axis, p, k, "valid")
            return a
        n = max(1, int(s) // 2)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(a, n, mode="edge"), (2 * n + 1, 2 * n + 1))
        if method == "box":
            return view.mean(axis=(2, 3))
        mid = np.stack([np.median(r, axis=(1, 2)) for r in view])
        return np.where(np.abs(a - mid) > threshold, mid, a)

    def kernel(a):
        for i in range(iterations):
            turned = np.rot90(a, 2) if i % 2 else a
            out = join(np.stack([one(turned, s) for s in sizes]), axis=0)
            a = np.rot90(out, 2) if i % 2 else out
        return a

    reach = max(max(1, int(np.ceil(3 * s)) if method == "iso" else int(s) // 2) for s in sizes)
    return _per_tile(pixels, kernel, reach * iterations, tile)


#: Steps of the denoising between two exchanges of borders: also the halo's width.
STEPS = 64


def regularise(pixels: DataFrame, weight: float = 1, iterations: int = 100, tile: int | None = None) -> DataFrame:
    """Total-variation denoising by gradient descent, then scaled to [0, 1]. A step reaches one pixel, so tiles take STEPS
    steps with a halo as wide before they exchange their borders."""
    if weight <= 0 or iterations < 1:
        raise ValueError("weight must be positive and iterations 1 or more")
    import numpy as np

    def descent(steps: int):
        def kernel(u, f):
            for _ in range(steps):
                dx, dy = np.diff(u, axis=0, append=u[-1:]), np.diff(u, axis=1, append=u[:, -1:])
                norm = np.sqrt(dx * dx + dy * dy + 1e-4)
                px, py = dx / norm, dy / norm
                div = px - np.roll(px, 1, 0) + py - np.roll(py, 1, 1)
                div[0] += np.roll(px, 1, 0)[0]
                div[:, 0] += np.roll(py, 1, 1)[:, 0]
                u = u + 0.1 * (weight * (f - u) + 0.1 * div)
            return u

        return kernel

    now = pixels.withColumn("given", F.col("value").cast("double"))
    for done in range(0, iterations, STEPS):
        steps = min(STEPS, iterations - done)
        now = _per_tile(now if not done else cut(now), descent(steps), steps, tile, ("given",))
    return _to_unit(now.select("dim", "x", "y", "value"))


def screened_poisson(pixels: DataFrame, weight: float = 0.1, tile: int | None = None) -> DataFrame:
    """Solves (weight - laplacian) u = - laplacian f by a Fourier transform of the mirrored image, then scales it to [0, 1]. What
    a pixel adds falls by exp(-root(weight)) a pixel, so tiles with a halo of 30 / root(weight) pixels give the whole
    image's values to some 12 digits; a task's memory grows with the halo."""
    if weight <= 0:
        raise ValueError("weight must be positive")
    import numpy as np

    def kernel(f):
        m = np.block([[f, f[:, ::-1]], [f[::-1], f[::-1, ::-1]]])
        wx, wy = 2 - 2 * np.cos(2 * np.pi * np.fft.fftfreq(m.shape[0])), 2 - 2 * np.cos(2 * np.pi * np.fft.fftfreq(m.shape[1]))
        lap = wx[:, None] + wy[None, :]
        return np.fft.ifft2(np.fft.fft2(m) * lap / (lap + weight)).real[: f.shape[0], : f.shape[1]]

    rate = float(np.arccosh(1 + weight / 2))
    return _to_unit(_per_tile(pixels, kernel, int(np.ceil(30 / rate)), tile))


def edges(pixels: DataFrame) -> DataFrame:
    """x, y, value: root of the summed squares of central differences over all dimensions."""
    def diff(axis: str, other: str) -> Column:
        w = W.partitionBy("dim", other).orderBy(axis)
        return (F.coalesce(F.lead("value").over(w), F.col("value")) - F.coalesce(F.lag("value").over(w), F.col("value"))) / 2

    g = pixels.withColumns({"gx": diff("x", "y"), "gy": diff("y", "x")})
    return g.groupBy("x", "y").agg(F.sqrt(F.sum(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("value"))
