"""Count normalisation, feature selection and scaling of long sparse tables. An absent row is a zero, so
means and variances divide by the number of cells, not of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_norm(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p of the share of a cell's total, times scale."""
    total = F.sum("value").over(W.partitionBy("barcode"))
    return counts.withColumn("value", F.log1p(F.col("value") / total * scale))


def moments(counts: DataFrame, n_cells: int | Column) -> DataFrame:
    """mean and var (sample) of each feature over all cells."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    s = counts.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count("*").alias("nnz"))
    return s.select("feature", "nnz", (F.col("s") / n).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("var"))


def zscale(counts: DataFrame, cells: DataFrame, clip: float = 10.0) -> DataFrame:
    """Dense z-scores of each feature over all cells, clipped from above; 0 for a constant feature."""
    m = moments(counts, cells.select("barcode").distinct().count())
    grid = cells.select("barcode").distinct().crossJoin(m)
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.sqrt("var")
    return grid.join(counts, ["feature", "barcode"], "left").select("feature", "barcode", F.when(F.col("var") > 0, F.least(z, F.lit(clip))).otherwise(F.lit(0.0)).alias("value"))


def variable_features(counts: DataFrame, n_cells: int, n_features: int = 2000) -> DataFrame:
    """The features of largest variance, ranked (ties by name)."""
    m = moments(counts, n_cells)
    return m.select("feature", "mean", "var").orderBy(F.desc("var"), "feature").limit(n_features).withColumn("rank", F.row_number().over(W.orderBy(F.desc("var"), "feature")))


#: Places at which the curve of variances is fitted, and the share of the range of log means that a fit reaches.
KNOTS, SPAN = 64, 0.3


def variance_curve(m: DataFrame) -> DataFrame:
    """m (feature, mean, var) with sd: the root of the variance expected at the feature's mean, by local quadratic
    regression of log10 variance on log10 mean. The fits at KNOTS places are aggregates; features interpolate in log10."""
    x = m.where("var > 0 and mean > 0").select(F.log10("mean").alias("x"), F.log10("var").alias("y"))
    span = x.agg(F.min("x").alias("lo"), F.greatest(F.max("x") - F.min("x"), F.lit(1e-9)).alias("wide"))
    pos = (F.col("x") - F.col("lo")) / F.col("wide") * (KNOTS - 1)
    reach = SPAN * (KNOTS - 1)
    near = F.sequence(F.greatest(F.lit(0), F.ceil(pos - reach)).cast("int"), F.least(F.lit(KNOTS - 1), F.floor(pos + reach)).cast("int"))
    rows = x.crossJoin(F.broadcast(span)).withColumn("knot", F.explode(near)).withColumn("u", (pos - F.col("knot")) / reach).withColumn("k", F.pow(1 - F.pow(F.abs("u"), 3), 3)).where("k > 0")
    s = rows.groupBy("knot").agg(*[F.sum(F.col("k") * F.pow("u", F.lit(p))).alias(f"u{p}") for p in range(5)], *[F.sum(F.col("k") * F.pow("u", F.lit(p)) * F.col("y")).alias(f"y{p}") for p in range(3)])
    # the fit at the knot itself is the constant of the quadratic: Cramer's rule, a constant where features are too few
    det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    u, y = [F.col(f"u{p}") for p in range(5)], [F.col(f"y{p}") for p in range(3)]
    whole = det((u[0], u[1], u[2]), (u[1], u[2], u[3]), (u[2], u[3], u[4]))
    fit = s.select("knot", F.when(whole > 1e-10 * F.pow(u[0], 3), det((y[0], u[1], u[2]), (y[1], u[2], u[3]), (y[2], u[3], u[4])) / whole).otherwise(y[0] / u[0]).alias("fit"))
    curve = fit.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("knot", "fit")))).alias("curve")).crossJoin(span)
    at = F.least(F.greatest((F.log10("mean") - F.col("lo")) / F.col("wide") * (KNOTS - 1), F.lit(0.0)), F.lit(KNOTS - 1.0))
    low = F.least(F.floor("at"), F.lit(KNOTS - 2)).cast("int")
    knot = lambda i: F.element_at("curve", i)
    between = knot(low) + (F.col("at") - low) * (F.coalesce(knot(low + 1), knot(low)) - knot(low))
    return m.crossJoin(F.broadcast(curve)).withColumn("at", at).withColumn("sd", F.when((F.col("var") > 0) & (F.col("mean") > 0), F.sqrt(F.pow(F.lit(10.0), between)))).drop("at", "curve", "lo", "wide")


def clipped_variance(counts: DataFrame, m: DataFrame, n_cells: int) -> DataFrame:
    """feature, variance of standardised counts ((value - mean) / sd, at most the root of the number of cells). m: feature,
    mean, sd. Zeros all have one value, so they are counted, not listed; a feature without sd has variance 0."""
    top = float(n_cells) ** 0.5
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(top))
    s = counts.where("value <> 0").join(m.where("sd > 0").select("feature", "mean", "sd"), "feature").groupBy("feature", "mean", "sd").agg(F.sum(z * z).alias("q"), F.count("*").alias("nnz"))
    zero = F.col("mean") / F.col("sd")
    found = s.select("feature", ((F.col("q") + (n_cells - F.col("nnz")) * zero * zero) / (n_cells - 1)).alias("v"))
    return m.select("feature").join(found, "feature", "left").select("feature", F.coalesce("v", F.lit(0.0)).alias("variance"))


def stabilised_features(counts: DataFrame, n_cells: int, n_features: int = 2000) -> DataFrame:
    """The features of largest standardised variance: feature, mean, var, variance, rank (ties by name)."""
    m = variance_curve(moments(counts.withColumn("value", F.col("value").cast("double")), n_cells).select("feature", "mean", "var"))
    out = m.join(clipped_variance(counts, m, n_cells), "feature").select("feature", "mean", "var", "variance")
    return out.orderBy(F.desc("variance"), "feature").limit(n_features).withColumn("rank", F.row_number().over(W.orderBy(F.desc("variance"), "feature")))


def tfidf(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p(tf * idf * scale): tf is the share of the cell's total, idf cells over cells with the feature."""
    n = counts.select("barcode").distinct().agg(F.count("*").alias("n"))
    total = F.sum("value").over(W.partitionBy("barcode"))
    df = counts.groupBy("feature").agg(F.count("*").alias("df"))
    return counts.withColumn("tf", F.col("value") / total).join(df, "feature").crossJoin(F.broadcast(n)).select("feature", "barcode", F.log1p(F.col("tf") * F.col("n") / F.col("df") * scale).alias("value"))


def top_features(counts: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Features whose total is above the quantile `cutoff` of all totals."""
    t = counts.groupBy("feature").agg(F.sum("value").alias("total"))
    return t.crossJoin(F.broadcast(t.agg(F.percentile("total", cutoff).alias("c")))).where("total > c").select("feature")


def pearson_residuals(counts: DataFrame, n_cells: int, theta: float = 100.0) -> DataFrame:
    """An approximation of regularised negative-binomial residuals: mean from row and column totals,
    one theta, clipped at the root of the number of cells. Rows with a count only."""
    both = counts.withColumns({"r": F.sum("value").over(W.partitionBy("feature")), "c": F.sum("value").over(W.partitionBy("barcode"))}).crossJoin(F.broadcast(counts.agg(F.sum("value").alias("t"))))
    mu = F.col("r") * F.col("c") / F.col("t")
    top = float(n_cells) ** 0.5
    return both.withColumn("mu", mu).select("feature", "barcode", F.greatest(F.lit(-top), F.least(F.lit(top), (F.col("value") - F.col("mu")) / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / theta))).alias("value"))


def no_norm(counts: DataFrame) -> DataFrame:
    return counts


def _dims(v: DataFrame) -> DataFrame:
    return v.select("barcode", F.posexplode("vec").alias("dim", "value")).withColumn("dim", F.col("dim") + 1)


def norm_dims(v: DataFrame, kind: str = "minmax") -> DataFrame:
    """barcode, dim, value of embeddings (barcode, vec), each dimension scaled: minmax (a constant one
    stays), z (sample deviation)."""
    long = _dims(v)
    if kind == "minmax":
        s = long.groupBy("dim").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        out = F.when(F.col("hi") == F.col("lo"), F.col("value")).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    elif kind == "z":
        s = long.groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
        out = (F.col("value") - F.col("m")) / F.col("sd")
    else:
        raise ValueError(f"unknown normalisation {kind!r}: minmax, z")
    return long.join(F.broadcast(s), "dim").select("barcode", "dim", out.alias("value"))


def quantile_norm(v: DataFrame, probes: int) -> DataFrame:
    """dim, i, value: quantiles (i - .5) / probes of each dimension (linear interpolation), in order."""
    ps = [(i - 0.5) / probes for i in range(1, probes + 1)]
    return _dims(v).groupBy("dim").agg(F.percentile("value", ps).alias("q")).select("dim", F.posexplode("q").alias("i", "value")).withColumn("i", F.col("i") + 1)


def snap(cells: DataFrame) -> DataFrame:
    """x and y moved to begin at 1; the original ones kept as x_orig, y_orig; z is 1."""
    low = cells.agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return cells.crossJoin(F.broadcast(low)).select("barcode", (F.col("x") - F.col("x0") + 1).alias("x"), (F.col("y") - F.col("y0") + 1).alias("y"), F.col("x").alias("x_orig"), F.col("y").alias("y_orig"), F.lit(1).alias("z"))
