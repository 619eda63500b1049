"""Negative-binomial models of counts between groups of cells, with shrinkage over features.

A cell's expected count is exp(its offset) times its group's level. With c = dispersion * level and u a cell's offset, the
likelihood needs, besides totals, only sum(y * f(log c + u)) over the counts of a feature and sum(f(log c + u)) over
the cells of a group, f(x) = log(1 + exp(x)). Both are kept as moments in bins of u, 1/16 wide (sums of y, y*d, y*d*d; d:
distance from the bin's middle), so f is expanded to second order within a bin and no worker sees cells. All is
additive: the cells outside a territory are all cells less its own, so each count is read once for all territories.

Offsets are trimmed-mean factors times totals, or medians of ratios. Both use all features of `counts`, also those that
are not tested. Features are smoothed over their abundance at KNOTS places a pair, which are aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import beta_i, gamma_q
from ..session import cut

#: Dispersions at which likelihoods are tabulated: a tenth times 2^-10 to 2^10; splines go between.
GRID = 0.1 * 2.0 ** np.arange(-10, 11)
BINS, KNOTS, SPAN = 16, 32, 0.3
#: Features whose log means one array holds in every task (16 MB).
MOST_FEATURES = 2_000_000


# --- offsets ---------------------------------------------------------------------------------------------------


def trimmed_mean_factors(counts: DataFrame, ratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """barcode, total, factor: trimmed mean of log ratios against a reference cell, whose upper quartile is nearest to
    the mean of all (or whose sum of roots is largest, where quartiles are mostly zero); factors have geometric mean 1.
    Ties of the reference go to the least barcode; ratios and sums that agree to 1e-9 have equal ranks."""
    counts = counts.where("value > 0").select("feature", "barcode", F.col("value").cast("double").alias("value"))
    n_features = counts.select("feature").distinct().agg(F.count("*").alias("g"))
    cell = W.partitionBy("barcode")
    v = counts.withColumn("total", F.sum("value").over(cell)).withColumn("m", F.count("*").over(cell)).withColumn("i", F.row_number().over(cell.orderBy("value", "feature"))).crossJoin(F.broadcast(n_features))
    spot = 0.75 * (F.col("g") - 1)
    place = F.col("g") - F.col("m") + F.col("i") - 1
    share = F.col("value") / F.col("total")
    at = lambda k: F.coalesce(F.max(F.when(place == k, share)), F.lit(0.0))
    per = v.groupBy("barcode", "total").agg(at(F.floor(spot)).alias("lo"), at(F.ceil(spot)).alias("hi"), F.max(spot - F.floor(spot)).alias("w"), F.sum(F.sqrt("value")).alias("roots"))
    per = cut(per.select("barcode", "total", "roots", (F.col("lo") + F.col("w") * (F.col("hi") - F.col("lo"))).alias("q")))
    mid = per.agg(F.avg("q").alias("mean"), (F.count(F.when(F.col("q") < 1e-20, 1)) * 2 > F.count("*")).alias("sparse"))
    score = F.when(F.col("sparse"), -F.col("roots")).otherwise(F.abs(F.col("q") - F.col("mean")))
    ref = per.crossJoin(F.broadcast(mid)).agg(F.min(F.struct(score.alias("score"), "barcode", "total")).alias("r")).select(F.col("r.barcode").alias("rb"), F.col("r.total").alias("rt"))
    ref = counts.join(ref, F.col("barcode") == F.col("rb")).select("feature", F.col("value").alias("rv"), "rt")
    x = counts.join(per.select("barcode", "total"), "barcode").join(ref, "feature")
    p, q = F.col("value") / F.col("total"), F.col("rv") / F.col("rt")
    x = x.select("barcode", "feature", F.log2(p / q).alias("ratio"), ((F.log2(p) + F.log2(q)) / 2).alias("sum"), ((F.col("total") - F.col("value")) / F.col("total") / F.col("value") + (F.col("rt") - F.col("rv")) / F.col("rt") / F.col("rv")).alias("var"))
    rank = lambda c: F.rank().over(cell.orderBy(F.round(c, 9))) + (F.count("*").over(W.partitionBy("barcode", F.round(c, 9))) - 1) / 2
    n = F.count("*").over(cell)
    inside = lambda r, trim: (F.col(r) >= F.floor(F.col("n") * trim) + 1) & (F.col(r) <= F.col("n") - F.floor(F.col("n") * trim))
    x = x.withColumns({"by_ratio": rank("ratio"), "by_sum": rank("sum"), "n": n, "widest": F.max(F.abs("ratio")).over(cell)})
    kept = F.when(inside("by_ratio", ratio_trim) & inside("by_sum", sum_trim) & (F.col("var") > 0), 1.0)
    f = x.groupBy("barcode").agg(F.when(F.max("widest") < 1e-6, 0.0).otherwise(F.sum(kept * F.col("ratio") / F.col("var")) / F.sum(kept / F.col("var"))).alias("f"))
    out = per.select("barcode", "total").join(f, "barcode", "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return out.crossJoin(F.broadcast(out.agg(F.avg("f").alias("mean")))).select("barcode", "total", F.pow(F.lit(2.0), F.col("f") - F.col("mean")).alias("factor"))


def median_ratio_factors(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """barcode, factor: the median over features of a cell's counts plus one over their geometric means over all cells.
    A feature that a cell lacks counts as one there, so a cell costs its own rows and one pass over the log means of all
    features, an array in every task (MOST_FEATURES at most, else ValueError)."""
    cells = cells.select("barcode").distinct()
    n = cells.count()
    logs = counts.where("value > 0").join(cells, "barcode", "left_semi").select("feature", "barcode", F.log1p(F.floor(F.col("value").cast("double"))).alias("y"))
    means = cut(logs.groupBy("feature").agg((F.sum("y") / n).alias("mean")).withColumn("i", F.monotonically_increasing_id()))
    size = means.count()
    if size > MOST_FEATURES:
        raise ValueError(f"{size} features; median ratios take {MOST_FEATURES} at most")
    order = means.select("feature", "mean", "i").toArrow()
    at = np.argsort(order["i"].to_numpy())
    level = -order["mean"].to_numpy()[at]
    places = {x: k for k, x in enumerate(np.sort(order["i"].to_numpy()).tolist())} if size else {}
    base = float(np.median(level)) if size else 0.0
    kind = counts.schema["barcode"].dataType.simpleString()

    def median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, ys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = level.copy()
                x[[places[i] for i in own]] += ys
                out.append(float(np.exp(np.median(x))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["barcode", "factor"])

    rows = logs.join(means.select("feature", "i"), "feature").groupBy("barcode").agg(F.collect_list(F.struct("i", "y")).alias("r")).select("barcode", F.transform("r", lambda r: r["i"]).alias("i"), F.transform("r", lambda r: r["y"]).alias("y"))
    found = rows.mapInArrow(median, f"barcode {kind}, factor double")
    return cells.join(found, "barcode", "left").withColumn("factor", F.coalesce("factor", F.lit(math.exp(base))))


# --- sums ------------------------------------------------------------------------------------------------------


def _moments(y: Column) -> list[Column]:
    return [F.sum(y).alias("a"), F.sum(y * F.col("d")).alias("b"), F.sum(y * F.col("d") * F.col("d")).alias("c")]


def _listed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b", "c"))).alias("m"))


def sums(counts: DataFrame, labels: DataFrame, kept: DataFrame, plus: int) -> DataFrame:
    """kept with, for seed and for all cells, moments of counts and of cells by bin and, at each dispersion of GRID, sums
    that depend on counts alone. labels: barcode, offset, scope and label (the pair of which a cell is seed, null: none).
    kept: pair, feature, scope (whose cells are the pair's), further columns. In one scope each count is read once."""
    cells = cut(labels.withColumn("bin", F.floor(F.col("offset") * BINS).cast("int")).withColumn("d", F.col("offset") - (F.col("bin") + 0.5) / BINS))
    whole = F.floor(F.col("value").cast("double")) if plus else F.col("value").cast("double")
    tested = kept.select("feature").distinct()
    rows = cut(counts.where("value > 0").join(tested, "feature", "left_semi").join(cells, "barcode").select("feature", "scope", "label", "bin", "d", whole.alias("y")))
    own = rows.groupBy("feature", "scope", "label", "bin").agg(*_moments(F.col("y")))
    more = [F.sum(c).alias(c) for c in "abc"]
    group = cells.groupBy("scope", "label", "bin").agg(*_moments(F.lit(1.0)))
    named = lambda df, name, **keys: df.select(*[F.col(k).alias(v) for k, v in keys.items()], F.col("m").alias(name))
    out = kept.join(named(_listed(own.groupBy("feature", "scope", "bin").agg(*more), "feature", "scope"), "y_all", feature="feature", scope="scope"), ["feature", "scope"])
    out = out.join(named(_listed(own.where("label is not null"), "feature", "label"), "y_seed", feature="feature", label="pair"), ["feature", "pair"], "left")
    out = out.join(named(_listed(group.where("label is not null"), "label"), "cells_seed", label="pair"), "pair")
    out = out.join(named(_listed(group.groupBy("scope", "bin").agg(*more), "scope"), "cells_all", scope="scope"), "scope")
    return out.join(_value_sums(rows.groupBy("feature", "scope", "y").agg(F.count("*").alias("t")), plus), ["feature", "scope"])


def _value_sums(values: DataFrame, plus: int) -> DataFrame:
    """feature, scope, nnz, gammas and saturated (arrays over GRID): sums over distinct counts y, t times each."""
    r = 1 / GRID

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, t = (np.asarray(batch.column(i)).astype(float) for i in (2, 3))
            y = y + plus
            g = t[:, None] * (lgamma(y[:, None] + r) - lgamma(r))
            s = t[:, None] * (np.where(y > 0, y * np.log(np.maximum(y, 1e-300)), 0.0)[:, None] - (y[:, None] + r) * np.log1p(GRID * y[:, None]))
            cols = [pa.array(x) for m in (g, s) for x in m.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t), *cols], names=names)

    names = ["feature", "scope", "t", *[f"g{k}" for k in range(len(GRID))], *[f"s{k}" for k in range(len(GRID))]]
    schema = ", ".join([f"feature {values.schema['feature'].dataType.simpleString()}", "scope string", *[f"{n} double" for n in names[2:]]])
    s = values.select("feature", "scope", "y", "t").mapInArrow(work, schema).groupBy("feature", "scope").agg(*[F.sum(n).alias(n) for n in names[2:]])
    pack = lambda p: F.array(*[F.col(f"{p}{k}") for k in range(len(GRID))])
    return s.select("feature", "scope", F.col("t").alias("nnz"), pack("g").alias("gammas"), pack("s").alias("saturated"))


# --- kernels over features -------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: recurrence up to 10, then Stirling's series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift[low] -= np.log(x[low])
        x[low] += 1
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + i * (1 / 12 - i * i * (1 / 360 - i * i * (1 / 1260 - i * i / 1680)))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    i = 1 / (x * x)
    return out + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i / 42))


def inverse_trigamma(y: float) -> float:
    x = 0.5 + 1 / y
    for _ in range(60):
        tri = float(trigamma(np.array([x]))[0])
        step = tri * (1 - tri / y) / float((trigamma(np.array([x * 1.0001]))[0] - tri) / (x * 0.0001))
        x += step
        if abs(step) < 1e-10 * x:
            break
    return x


class Side:
    """Moments of counts (features x bins) and of cells (bins) of a group of cells."""

    def __init__(self, y: np.ndarray, cells: np.ndarray, mid: np.ndarray):
        self.y, self.cells, self.mid = y, cells, mid
        self.total, self.n = y[0].sum(1), cells[0].sum(1)
        self.exposure = (cells[0] * np.exp(mid) + cells[1] * np.exp(mid) + cells[2] / 2 * np.exp(mid)).sum(1)
        self.yu = (y[0] * mid + y[1]).sum(1)

    def at(self, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """For log c = t (features x k): sums of y f, y f', y f'', f, f', f'' over counts and cells."""
        x = t[:, :, None] + self.mid
        f, s = np.logaddexp(0, x), 1 / (1 + np.exp(-np.clip(x, -700, 700)))
        s1 = s * (1 - s)
        s2, s3 = s1 * (1 - 2 * s), s1 * (1 - 6 * s1)
        three = lambda m, a, b, c: np.einsum("gb,gkb->gk", m[0], a) + np.einsum("gb,gkb->gk", m[1], b) + np.einsum("gb,gkb->gk", m[2], c) / 2
        out = [three(m, *d) for m in (self.y, self.cells) for d in ((f, s, s1), (s, s1, s2), (s1, s2, s3))]
        return tuple(out)

    def fit(self, r: np.ndarray) -> np.ndarray:
        """log c of the likeliest level for 1 / dispersion = r (features x k): sum (y + r) f' = sum y, by Newton steps on
        logarithms. Where all counts are zero the level is nothing."""
        some = self.total > 0
        goal = np.log(np.where(some, self.total, 1.0))[:, None]
        t = goal - np.log(np.maximum(self.exposure, 1e-300))[:, None] - np.log(r)
        for _ in range(60):
            _, a, a1, _, b, b1 = self.at(t)
            have = np.maximum(a + r * b, 1e-300)
            step = np.clip((goal - np.log(have)) * have / np.maximum(a1 + r * b1, 1e-300), -2, 2)
            t = t + step
            if np.abs(step[some]).max(initial=0) < 1e-9:
                break
        return np.where(some[:, None], t, -80.0)

    def loglik(self, t: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood less what doesn't depend on the level, and the sum of weights y's variance gives (for Cox-Reid)."""
        h, _, _, b0, b1, _ = self.at(t)
        return np.where(self.total[:, None] > 0, self.total[:, None] * t - h - r * b0, 0.0), r * b1


def _dense(col: pa.Array, low: int, width: int) -> np.ndarray:
    out = np.zeros((3, len(col), width))
    lengths = np.asarray(col.value_lengths().fill_null(0)).astype(int)
    at, flat = np.repeat(np.arange(len(col)), lengths), col.flatten()
    if len(flat):
        bins = np.asarray(flat.field("bin")) - low
        for k, c in enumerate("abc"):
            out[k, at, bins] = np.asarray(flat.field(c))
    return out


def sides(batch: pa.RecordBatch, plus: int) -> tuple[Side, Side, Side]:
    """Seed, query and all cells of a batch of features."""
    col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    bins = [np.asarray(col[c].flatten().field("bin")) for c in ("cells_all", "y_all")]
    low, width = min(int(b.min()) for b in bins), max(int(b.max()) for b in bins) - min(int(b.min()) for b in bins) + 1
    y, y1, c, c1 = (_dense(col[k], low, width) for k in ("y_all", "y_seed", "cells_all", "cells_seed"))
    y, y1 = y + plus * c, y1 + plus * c1
    mid = (np.arange(low, low + width) + 0.5) / BINS
    return Side(y1, c1, mid), Side(y - y1, c - c1, mid), Side(y, c, mid)


class Spline:
    """Natural cubic splines through rows of values over log2(GRID)."""

    def __init__(self, values: np.ndarray):
        n = values.shape[1]
        a = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
        self.v, self.m = values, np.zeros_like(values)
        self.m[:, 1:-1] = np.linalg.solve(a, 6 * (values[:, 2:] - 2 * values[:, 1:-1] + values[:, :-2]).T).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """x: places (features x k), 0 for the first dispersion, 1 for the next."""
        i = np.clip(x.astype(int), 0, self.v.shape[1] - 2)
        w, g = x - i, np.arange(len(self.v))[:, None]
        lo, hi = self.m[g, i], self.m[g, i + 1]
        return self.v[g, i] * (1 - w) + self.v[g, i + 1] * w - w * (1 - w) / 6 * ((2 - w) * lo + (1 + w) * hi)

    def peak(self, extra=lambda x: 0.0) -> np.ndarray:
        """The place of the largest value, with extra(x) added, by narrowing grids."""
        low, high = np.zeros((len(self.v), 1)), np.full((len(self.v), 1), self.v.shape[1] - 1.0)
        for _ in range(6):
            x = low + (high - low) * np.linspace(0, 1, 41)
            at = np.argmax(self(x) + extra(x), axis=1)[:, None]
            step = (high - low) / 40
            mid = np.take_along_axis(x, at, 1)
            low, high = np.maximum(mid - step, 0), np.minimum(mid + step, self.v.shape[1] - 1.0)
        return mid[:, 0]


def place(dispersion: np.ndarray) -> np.ndarray:
    return np.log2(dispersion / GRID[0])


def adjusted_profile(seed: Side, query: Side, gammas: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted profile likelihood of each feature at each dispersion of GRID."""
    r = np.broadcast_to(1 / GRID, gammas.shape)
    out = gammas.copy()
    for s in (seed, query):
        ll, weight = s.loglik(s.fit(r), r)
        out += ll - np.where(s.total[:, None] > 0, 0.5 * np.log(np.maximum(weight, 1e-300)), 0.0)
    return out


def ratio(seed: Side, query: Side, both: Side, dispersion: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood ratio statistic of two levels against one, and log2 of the levels' quotient."""
    r = 1 / dispersion[:, None]
    t = [s.fit(r) for s in (seed, query, both)]
    ll = [s.loglik(x, r)[0][:, 0] for s, x in zip((seed, query, both), t, strict=True)]
    small = np.log(np.minimum(0.125 / np.maximum(both.n, 1), 1.0))  # stands for no counts at all
    level = [np.where(s.total > 0, x[:, 0] + np.log(r[:, 0]), small) for s, x in zip((seed, query), t[:2], strict=True)]
    return np.maximum(0.0, 2 * (ll[0] + ll[1] - ll[2])), (level[0] - level[1]) / math.log(2)


def deviance(seed: Side, query: Side, saturated: np.ndarray, dispersion: np.ndarray) -> np.ndarray:
    r = 1 / dispersion[:, None]
    out = Spline(saturated)(place(dispersion)[:, None])[:, 0]
    for s in (seed, query):
        t = s.fit(r)
        h, _, _, b, _, _ = s.at(t)
        out -= np.where(s.total > 0, s.total * (t[:, 0] + np.log(r[:, 0])) + s.yu - h[:, 0] - r[:, 0] * b[:, 0], 0.0)
    return np.maximum(0.0, 2 * out)


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isinf(d2):
        return gamma_q(d1 / 2, d1 * f / 2)
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


# --- smoothing over features -----------------------------------------------------------------------------------


def _knots(t: DataFrame, x: str) -> DataFrame:
    """Rows of t at the knots of their pair that are within SPAN of its range, with knot and tricube weight k."""
    span = t.groupBy("pair").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    t = t.join(span, "pair").withColumn("pos", (F.col(x) - F.col("lo")) / wide * (KNOTS - 1))
    reach = SPAN * (KNOTS - 1)
    near = F.sequence(F.greatest(F.lit(0), F.ceil(F.col("pos") - reach)).cast("int"), F.least(F.lit(KNOTS - 1), F.floor(F.col("pos") + reach)).cast("int"))
    off = F.abs(F.col("pos") - F.col("knot")) / reach
    return t.withColumn("knot", F.explode(near)).withColumn("k", F.pow(1 - F.pow(F.least(off, F.lit(1.0)), 3), 3)).where("k > 0")


def _with_trend(t: DataFrame, x: str, table: DataFrame) -> DataFrame:
    """t with `pos` (its place between knots) and the pair's `table` (an array over knots)."""
    span = t.groupBy("pair").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9))
    return t.join(span.join(table, "pair"), "pair").withColumn("pos", (F.col(x) - F.col("lo")) / wide * (KNOTS - 1)).drop("lo", "hi")


def _between(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The pair's table at each feature's place: features x values, linear between knots. Knots without features (or with
    nothing) take the nearest one's value."""
    col = batch.column(batch.schema.get_field_index(name))
    tables, out = {}, []
    for n, (pair, pos) in enumerate(zip(batch.column(batch.schema.get_field_index("pair")).to_pylist(), np.asarray(batch.column(batch.schema.get_field_index("pos"))).tolist(), strict=True)):
        if pair not in tables:
            have = sorted((r["knot"], r["v"]) for r in col[n].as_py())
            at, v = np.array([h[0] for h in have], float), np.array([h[1] for h in have], float)
            tables[pair] = np.stack([np.interp(np.arange(KNOTS), at, v[:, k]) for k in range(v.shape[1])], 1)
        m, i = tables[pair], min(max(int(pos), 0), KNOTS - 2)
        out.append(m[i] + min(max(pos - i, 0.0), 1.0) * (m[i + 1] - m[i]))
    return np.array(out)


def _tabled(df: DataFrame, value: Column) -> DataFrame:
    """pair, table: the value (an array) of each knot."""
    return df.select("pair", F.struct("knot", value.alias("v")).alias("s")).groupBy("pair").agg(F.array_sort(F.collect_list("s")).alias("table"))


def _map(df: DataFrame, kernel, add: dict[str, str], drop: tuple[str, ...] = (), rows: int = 256) -> DataFrame:
    """df less `drop`, with columns that kernel(batch) returns for parts of `rows` features."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} {k}" for n, k in add.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                got = kernel(part)
                new = [pa.array(list(v) if v.ndim > 1 else v) for v in got]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in keep] + new, names=[f.name for f in keep] + list(add))

    return df.mapInArrow(work, schema)


_MOMENTS = ("y_all", "y_seed", "cells_all", "cells_seed")


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array(batch.column(batch.schema.get_field_index(name)).to_pylist(), float)


def _num(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name))).astype(float)


def quasi_likelihood(counts: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with dispersions (trend, tagwise), lr_p (likelihood ratio at the tagwise dispersion), f_p (quasi-likelihood F at
    the trend, with shrunk residual variances), df_prior and log2_fold. labels: barcode, scope, label, as in sums().

    Features' adjusted profile likelihoods are averaged at knots of abundance; the peak of that average is the trend, and the
    peak of a feature's own likelihood plus prior weight times the average is its tagwise dispersion. Residual variances are
    scaled chi-squares around a trend of their own; their spread over features gives the prior's degrees of freedom."""
    size = trimmed_mean_factors(counts.join(labels.select("barcode").distinct(), "barcode", "left_semi"))
    offset = F.log(F.col("total") * F.col("factor"))
    typical = size.agg(F.avg(F.log("total")).alias("typical"))
    cells = labels.join(size, "barcode").crossJoin(F.broadcast(typical)).select("barcode", "scope", "label", (offset - F.col("typical")).alias("offset"))
    base = cut(sums(counts, cells, kept, 0))

    def profile(batch):
        seed, query, both = sides(batch, 0)
        apl = adjusted_profile(seed, query, _arrays(batch, "gammas"))
        df = np.where(seed.total > 0, seed.n - 1, 0) + np.where(query.total > 0, query.n - 1, 0)
        return np.log2((both.total + 0.5) / both.exposure), apl, np.maximum(df, 1.0)

    own = cut(_map(base, profile, {"abundance": "double", "apl": "array<double>", "df": "double"}))
    mean = lambda k: F.sum(F.col("k") * F.col("apl")[k]) / F.sum("k")
    shared = _knots(own.select("pair", "abundance", "apl"), "abundance").groupBy("pair", "knot").agg(F.array(*[mean(k) for k in range(len(GRID))]).alias("v"))
    own = _with_trend(own, "abundance", _tabled(shared, F.col("v")).withColumnRenamed("table", "shared"))

    def residual(batch):
        seed, query, _ = sides(batch, 0)
        average = _between(batch, "shared")
        trend = GRID[0] * 2 ** Spline(average).peak()
        df = _num(batch, "df")
        s2 = np.maximum(deviance(seed, query, _arrays(batch, "saturated"), trend) / df, 1e-10)
        return trend, average, s2, np.log(s2) - digamma(df / 2) + np.log(df / 2), trigamma(df / 2)

    own = cut(_map(own, residual, {"trend": "double", "average": "array<double>", "s2": "double", "e": "double", "noise": "double"}, ("shared", "saturated", "gammas", "pos")))
    level = _knots(own.select("pair", "abundance", "e"), "abundance").groupBy("pair", "knot").agg(F.array(F.sum(F.col("k") * F.col("e")) / F.sum("k")).alias("v"))
    own = _with_trend(own, "abundance", _tabled(level, F.col("v")).withColumnRenamed("table", "levels"))
    own = cut(_map(own, lambda b: (_between(b, "levels")[:, 0],), {"level": "double"}, ("levels", "pos")))
    d = F.col("e") - F.col("level")
    spread = own.groupBy("pair").agg((F.sum(d * d) / F.greatest(F.count("*") - 1, F.lit(1)) - F.avg("noise")).alias("over"), F.sum("df").alias("df_all"))

    def decide(batch):
        seed, query, both = sides(batch, 0)
        df, over, most = _num(batch, "df"), _num(batch, "over"), _num(batch, "df_all")
        prior = np.array([2 * inverse_trigamma(v) if v > 1e-6 else np.inf for v in over])
        known = np.isfinite(prior)
        half = np.where(known, prior, 2.0) / 2
        centre = np.exp(_num(batch, "level") + np.where(known, digamma(half) - np.log(half), 0.0))
        post = np.where(known, (df * _num(batch, "s2") + np.where(known, prior, 0) * centre) / (df + np.where(known, prior, 0)), centre)
        trend = _num(batch, "trend")
        lr, fold = ratio(seed, query, both, trend)
        f_p = [f_tail(x / s, 1, min(a + b, m)) for x, s, a, b, m in zip(lr, post, prior, df, most, strict=True)]
        average = Spline(_arrays(batch, "average"))
        weight = np.where(known, prior / df, 1e6)[:, None]
        tagwise = GRID[0] * 2 ** Spline(_arrays(batch, "apl")).peak(lambda x: weight * average(x))
        lr2, _ = ratio(seed, query, both, tagwise)
        return tagwise, np.array([gamma_q(0.5, x / 2) for x in lr2]), np.array(f_p), prior, fold

    out = _map(own.join(spread, "pair"), decide, {"tagwise": "double", "lr_p": "double", "f_p": "double", "df_prior": "double", "log2_fold": "double"}, (*_MOMENTS, "apl", "average", "over", "df_all"))
    return out.select(*kept.columns, "trend", "tagwise", "s2", "df_prior", "lr_p", "f_p", "log2_fold")


def shrunk_dispersion(counts: DataFrame, labels: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with dispersions (own, trend, shrunk), lr_p and log2_fold, on counts plus one with medians of ratios as offsets.

    log dispersions follow a local linear fit on log means (weighted by the mean) at knots; a feature's own likelihood is
    shrunk by a normal prior around it, as wide as the residuals less their sampling variance (a quarter at least), unless
    it lies more than two residual deviations above."""
    size = median_ratio_factors(counts.join(labels.select("barcode"), "barcode", "left_semi"), labels)
    base = cut(sums(counts, labels.join(size, "barcode").select("barcode", "scope", "label", F.log("factor").alias("offset")), kept, 1))

    def profile(batch):
        seed, query, both = sides(batch, 1)
        nnz = _num(batch, "nnz")
        gammas = _arrays(batch, "gammas") + (both.n - nnz)[:, None] * np.log(1 / GRID)  # absent counts are ones
        apl = adjusted_profile(seed, query, gammas)
        y, mid = both.y, both.mid
        mean = ((y[0] - y[1] + y[2] / 2) * np.exp(-mid)).sum(1) / both.n
        return np.log(np.maximum(mean, 1e-8)), apl, np.log(GRID[0]) + math.log(2) * Spline(apl).peak(), both.n - 2

    own = cut(_map(base, profile, {"mean": "double", "apl": "array<double>", "own": "double", "df": "double"}))
    fit = own.where(F.col("own") > math.log(GRID[0]) + 0.01)
    w = F.col("k") * F.exp("mean")
    x = F.col("mean") - F.col("lo") - F.col("knot") / (KNOTS - 1) * (F.col("hi") - F.col("lo"))
    s = _knots(fit.select("pair", "mean", "own"), "mean").groupBy("pair", "knot").agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * x * x).alias("xx"), F.sum(w * F.col("own")).alias("y"), F.sum(w * x * F.col("own")).alias("xy"))
    det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    line = F.when(det > 1e-9 * F.col("w") * F.col("xx"), (F.col("xx") * F.col("y") - F.col("x") * F.col("xy")) / det).otherwise(F.col("y") / F.col("w"))
    table = _tabled(s.where("w > 0"), F.array(line)).withColumnRenamed("table", "line")
    span = own.select("pair").distinct().join(table, "pair", "left").withColumn("line", F.coalesce("line", F.array(F.struct(F.lit(0).alias("knot"), F.array(F.lit(math.log(GRID[0]))).alias("v")))))
    own = _with_trend(own, "mean", span)
    own = cut(_map(own, lambda b: (np.clip(_between(b, "line")[:, 0], math.log(GRID[0]), math.log(GRID[-1])),), {"trend": "double"}, ("line", "pos")))
    off = own.where(F.col("own") > math.log(GRID[0]) + 0.01).select("pair", (F.col("own") - F.col("trend")).alias("off"))
    mid = off.groupBy("pair").agg(F.percentile_approx("off", 0.5, 10_000).alias("mid"))
    spread = off.join(mid, "pair").groupBy("pair").agg((1.4826 * F.percentile_approx(F.abs(F.col("off") - F.col("mid")), 0.5, 10_000)).alias("mad"))
    own = own.join(spread, "pair", "left").withColumn("mad", F.coalesce("mad", F.lit(0.5)))

    def decide(batch):
        seed, query, both = sides(batch, 1)
        mad, trend, first = (_num(batch, c) for c in ("mad", "trend", "own"))
        width = np.maximum(mad**2 - trigamma(_num(batch, "df") / 2), 0.25)[:, None]
        centre = place(np.exp(trend))[:, None]
        shrunk = np.log(GRID[0]) + math.log(2) * Spline(_arrays(batch, "apl")).peak(lambda x: -(((x - centre) * math.log(2)) ** 2) / (2 * width))
        shrunk = np.where(first > trend + 2 * mad, first, shrunk)
        lr, fold = ratio(seed, query, both, np.exp(shrunk))
        return np.exp(shrunk), np.array([gamma_q(0.5, x / 2) for x in lr]), fold

    out = _map(own, decide, {"shrunk": "double", "lr_p": "double", "log2_fold": "double"}, (*_MOMENTS, "apl", "gammas", "saturated"))
    return out.select(*kept.columns, F.exp("own").alias("own_dispersion"), F.exp("trend").alias("trend"), F.col("shrunk").alias("dispersion"), "lr_p", "log2_fold")
