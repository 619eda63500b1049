"""Differential expression between groups of cells, over long sparse counts in one pass for all pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import benjamini_hochberg, chi2_tail, effect_size, fisher_two_sided, holm, normal_two_sided, rank_sum_two_sided, t_two_sided
from ..session import cut
from . import count_models

METHODS = ("wilcox", "t.test", "chisq", "fisher.exact", "DESeq2", "QLF", "LRT", "logit")


def groups(cells: DataFrame, seed: list[str] | None = None, query: list[str] | None = None, cells_of_interest: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """pair, side (seed or query), seed, query, barcode: without seed and query each territory against the
    rest; one of them against the rest; or both. cells (barcode) narrow both sides; samples (barcode,
    sample) put reference cells on the seed side and matched ones on the query side."""
    lab = cells.select("barcode", F.col("territory").cast("string").alias("territory"))
    if cells_of_interest is not None:
        lab = lab.join(cells_of_interest.select("barcode").distinct(), "barcode", "left_semi")
    name = lambda ts: F.lit(" ".join(map(str, ts)))
    if not seed and not query:
        each = lab.select("territory").distinct().withColumnRenamed("territory", "seed")
        rows = lab.crossJoin(each).select(F.col("seed").alias("pair"), F.when(F.col("territory") == F.col("seed"), "seed").otherwise("query").alias("side"), "seed", F.lit("remaining").alias("query"), "barcode")
    else:
        s = F.col("territory").isin([str(t) for t in seed]) if seed else ~F.col("territory").isin([str(t) for t in query])
        q = F.col("territory").isin([str(t) for t in query]) if query else ~F.col("territory").isin([str(t) for t in seed])
        rows = lab.select(F.lit("1").alias("pair"), F.when(s, "seed").when(q, "query").alias("side"), (name(seed) if seed else F.lit("remaining")).alias("seed"), (name(query) if query else F.lit("remaining")).alias("query"), "barcode").where("side is not null")
    if samples is not None:
        keep = ((F.col("side") == "seed") & (F.col("sample") == "reference")) | ((F.col("side") == "query") & (F.col("sample") == "matched"))
        rows = rows.join(samples, "barcode").where(keep).select("pair", "side", F.concat("seed", F.lit("_reference")).alias("seed"), F.concat("query", F.lit("_matched")).alias("query"), "barcode")
    return rows


def metrics(counts: DataFrame, grouped: DataFrame, min_cells: int = 10) -> DataFrame:
    """pair, feature, seed, query, sizes n1 and n2, share of cells with the feature, means, variances and
    fold change (difference of means); pairs with a side of under min_cells cells are left out."""
    side = lambda s: F.when(F.col("side") == s, F.col("value"))
    sizes = grouped.groupBy("pair", "seed", "query").agg(F.count(F.when(F.col("side") == "seed", 1)).alias("n1"), F.count(F.when(F.col("side") == "query", 1)).alias("n2")).where((F.col("n1") >= min_cells) & (F.col("n2") >= min_cells))
    sums = counts.join(grouped.select("pair", "side", "barcode"), "barcode").groupBy("pair", "feature").agg(
        *[a.alias(n + k) for k, s in (("1", "seed"), ("2", "query")) for n, a in (("s", F.coalesce(F.sum(side(s)), F.lit(0.0))), ("q", F.coalesce(F.sum(side(s) * F.col("value")), F.lit(0.0))), ("p", F.count(F.when((F.col("side") == s) & (F.col("value") > 0), 1))))])
    m = sums.join(sizes, "pair")
    var = lambda k: (F.col("q" + k) - F.col("s" + k) * F.col("s" + k) / F.col("n" + k)) / (F.col("n" + k) - 1)
    return m.select("pair", "feature", "seed", "query", "n1", "n2", (F.col("p1") / F.col("n1")).alias("seed_pct"), (F.col("p2") / F.col("n2")).alias("query_pct"), (F.col("s1") / F.col("n1")).alias("mean1"), (F.col("s2") / F.col("n2")).alias("mean2"), var("1").alias("var1"), var("2").alias("var2"), (F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")).alias("fold_change"))


def metrics_of_rest(counts: DataFrame, cells: DataFrame, min_cells: int = 10) -> DataFrame:
    """metrics() of each territory against the rest without a row for each cell and territory: a territory's sums are taken
    once, and the rest's are those of all cells less its own."""
    lab = cells.select("barcode", F.col("territory").cast("string").alias("pair"))
    sizes = lab.groupBy("pair").agg(F.count("*").alias("n1"))
    sizes = sizes.crossJoin(F.broadcast(lab.agg(F.count("*").alias("n")))).withColumn("n2", F.col("n") - F.col("n1")).where((F.col("n1") >= min_cells) & (F.col("n2") >= min_cells))
    v = F.col("value").cast("double")
    own = cut(counts.join(lab, "barcode").groupBy("feature", "pair").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("q1"), F.count(F.when(v > 0, 1)).alias("p1")))
    total = own.groupBy("feature").agg(F.sum("s1").alias("s"), F.sum("q1").alias("q"), F.sum("p1").alias("p"))
    m = total.crossJoin(sizes.drop("n")).join(own, ["feature", "pair"], "left").fillna(0, ["s1", "q1", "p1"])
    m = m.withColumns({c + "2": F.col(c) - F.col(c + "1") for c in "sqp"})
    var = lambda k: (F.col("q" + k) - F.col("s" + k) * F.col("s" + k) / F.col("n" + k)) / (F.col("n" + k) - 1)
    return m.select("pair", "feature", F.col("pair").alias("seed"), F.lit("remaining").alias("query"), "n1", "n2", (F.col("p1") / F.col("n1")).alias("seed_pct"), (F.col("p2") / F.col("n2")).alias("query_pct"), (F.col("s1") / F.col("n1")).alias("mean1"), (F.col("s2") / F.col("n2")).alias("mean2"), var("1").alias("var1"), var("2").alias("var2"), (F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")).alias("fold_change"))


def tested(m: DataFrame, min_pct: float = 0.05, log_fc: float = 0.25) -> DataFrame:
    return m.where(((F.col("seed_pct") >= min_pct) | (F.col("query_pct") >= min_pct)) & (F.abs("fold_change") >= log_fc))


def rank_sum(counts: DataFrame, grouped: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with w (rank sum statistic of the seed side), z (tie and continuity corrected) and ties (sum of t^3 - t). The
    zeros of a feature are one tied block, taken from the sizes and never made into rows."""
    rows = counts.where("value > 0").join(grouped.select("pair", "side", "barcode"), "barcode").join(kept.select("pair", "feature", "n1", "n2"), ["pair", "feature"])
    # a row for each distinct value: ranks need no more
    v = rows.groupBy("pair", "feature", "n1", "n2", "value").agg(F.count("*").alias("t"), F.count(F.when(F.col("side") == "seed", 1)).alias("t1"))
    f = W.partitionBy("pair", "feature")
    n = F.col("n1") + F.col("n2")
    below = F.sum("t").over(f.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    v = v.withColumn("zero", n - F.sum("t").over(f)).withColumn("zero1", F.col("n1") - F.sum("t1").over(f)).withColumn("rank", F.col("zero") + below + (F.col("t") + 1) / 2)
    cube = lambda c: F.pow(F.col(c), 3) - F.col(c)
    s = v.groupBy("pair", "feature", "n1", "n2").agg((F.sum(F.col("t1") * F.col("rank")) + F.first("zero1") * (F.first("zero") + 1) / 2).alias("r1"), (F.sum(cube("t")) + F.first(cube("zero"))).alias("ties"))
    return kept.join(_statistic(s).select("pair", "feature", "w", "z", "ties"), ["pair", "feature"])


def _statistic(s: DataFrame) -> DataFrame:
    """s (n1, n2, r1, ties) with w and z."""
    n = F.col("n1") + F.col("n2")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    d = F.col("w") - F.col("n1") * F.col("n2") / 2
    return s.withColumn("w", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("z", F.when(sd > 0, (d - F.signum(d) * 0.5) / sd).otherwise(F.lit(0.0)))


def rank_sum_of_rest(counts: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """rank_sum() of each territory against the rest. All pairs rank the same cells, so a feature's distinct values are
    ranked once, and a territory adds up the ranks of its own values."""
    lab = cells.select("barcode", F.col("territory").cast("string").alias("pair"))
    own = cut(counts.where("value > 0").join(kept.select("feature").distinct(), "feature", "left_semi").join(lab, "barcode").groupBy("feature", "value", "pair").agg(F.count("*").alias("t1")))
    f = W.partitionBy("feature")
    n = lab.agg(F.count("*").alias("n"))
    v = own.groupBy("feature", "value").agg(F.sum("t1").alias("t")).crossJoin(F.broadcast(n))
    below = F.sum("t").over(f.orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    v = v.withColumn("zero", F.col("n") - F.sum("t").over(f)).withColumn("rank", F.col("zero") + below + (F.col("t") + 1) / 2)
    cube = lambda c: F.pow(F.col(c), 3) - F.col(c)
    ties = v.groupBy("feature").agg(F.first("zero").alias("zero"), (F.sum(cube("t")) + F.first(cube("zero"))).alias("ties"))
    sums = own.join(v.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", "pair").agg(F.sum(F.col("t1") * F.col("rank")).alias("r"), F.sum("t1").alias("found"))
    s = kept.join(ties, "feature").join(sums, ["feature", "pair"], "left").fillna(0, ["r", "found"])
    return _statistic(s.withColumn("r1", F.col("r") + (F.col("n1") - F.col("found")) * (F.col("zero") + 1) / 2)).drop("zero", "r", "found", "r1")


def welch(m: DataFrame) -> DataFrame:
    """m with t and df of Welch's test."""
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    return m.withColumn("t", (F.col("mean1") - F.col("mean2")) / F.sqrt(a + b)).withColumn("df", F.pow(a + b, 2) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)))


def _per_feature(counts: DataFrame, grouped: DataFrame, kept: DataFrame, kernel) -> DataFrame:
    """p_value of each pair and feature from kernel(values of seed, values of query), zeros filled in."""
    rows = kept.select("pair", "feature", "n1", "n2").join(grouped.select("pair", "side", "barcode").join(counts, "barcode"), ["pair", "feature"])

    def run(f):
        import numpy as np
        import pandas as pd

        a, b = (np.concatenate([(x := f.loc[f["side"] == s, "value"].to_numpy(float)), np.zeros(int(f[n].iloc[0]) - len(x))]) for s, n in (("seed", "n1"), ("query", "n2")))
        return pd.DataFrame({"pair": [f["pair"].iloc[0]], "feature": [f["feature"].iloc[0]], "p_value": [float(kernel(a, b))]})

    return rows.groupBy("pair", "feature").applyInPandas(run, "pair string, feature string, p_value double")


def logit_p(a, b) -> float:
    """Likelihood ratio test of a logistic regression of the side on the value against none."""
    import numpy as np

    x, y = np.concatenate([a, b]), np.concatenate([np.ones(len(a)), np.zeros(len(b))])
    design, beta = np.stack([np.ones(len(x)), (x - x.mean()) / (x.std() or 1)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-10)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + 1e-9 * np.eye(2), design.T @ (y - p))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -30, 30))), 1e-15, 1 - 1e-15)
    m = y.mean()
    full, none = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), len(y) * (m * np.log(m) + (1 - m) * np.log(1 - m))
    return chi2_tail(max(0.0, 2 * (full - none)), 1)


#: Sides of under so many cells, without ties, have exact p-values.
EXACT = 50


def _wilcox(z: float, w: float, ties: float, n1: float, n2: float) -> float:
    return rank_sum_two_sided(int(round(w)), int(n1), int(n2)) if ties == 0 and n1 < EXACT and n2 < EXACT else normal_two_sided(z)


def _values(name: str, *cols):
    """A batched UDF over the results of tests (a row for each feature, not for each count)."""
    fns = {"t": t_two_sided, "effect": lambda p, a, b: effect_size(p, int(a), int(b)), "fisher": lambda a, b, n1, n2: fisher_two_sided(int(a), int(n1 - a), int(b), int(n2 - b)), "chisq": _chisq, "wilcox": _wilcox}

    def f(*values: pd.Series) -> pd.Series:
        return pd.Series([fns[name](*v) for v in zip(*values, strict=True)], dtype=float)

    return F.pandas_udf(f, "double")(*cols)


def rank_sum_p():
    """p-value of a row of rank_sum(): exact under EXACT cells a side without ties."""
    return _values("wilcox", F.col("z"), F.col("w"), F.col("ties"), F.col("n1").cast("double"), F.col("n2").cast("double"))


def _chisq(a: float, b: float, n1: float, n2: float) -> float:
    k, n = a + b, n1 + n2
    if k in (0, n):
        return 1.0
    d = max(0.0, abs(a * (n2 - b) - b * (n1 - a)) - n / 2)
    return chi2_tail(n * d * d / (n1 * n2 * k * (n - k)), 1)


def identify_markers(counts: DataFrame, cells: DataFrame, seed=None, query=None, method: str = "wilcox", log_fc: float = 0.25, pval: float = 0.05, min_pct: float = 0.05, min_cells: int = 10, genes: list[str] | None = None, cells_of_interest=None, samples=None) -> DataFrame:
    """genes, p_value, p_value_adj, seed_pct, query_pct, fold_change, effect_size, seed, query. chisq and
    fisher.exact test the shares of cells with the feature, feature by feature. DESeq2, QLF and LRT are models of raw
    counts (count_models); their fold_change is the log2 quotient of fitted levels, and their p-values are adjusted by
    Benjamini and Hochberg's method, those of the others by Holm's."""
    method = {"DEseq2": "DESeq2"}.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
    counts = counts.where(F.col("feature").isin(genes)) if genes else counts
    rest = not seed and not query and samples is None
    narrowed = cells if cells_of_interest is None else cells.join(cells_of_interest.select("barcode").distinct(), "barcode", "left_semi")
    grouped = None if rest else groups(cells, seed, query, cells_of_interest, samples)
    kept = tested(metrics_of_rest(counts, narrowed, min_cells) if rest else metrics(counts, grouped, min_cells), min_pct, log_fc)
    n1, n2 = kept["n1"].cast("double"), kept["n2"].cast("double")
    if method == "wilcox":
        r = rank_sum_of_rest(counts, narrowed, kept) if rest else rank_sum(counts, grouped, kept)
        r = r.withColumn("p_value", rank_sum_p())
    elif method == "t.test":
        r = welch(kept)
        r = r.withColumn("p_value", _values("t", r["t"], r["df"]))
    elif method in ("chisq", "fisher.exact"):
        r = kept.withColumn("p_value", _values(method.split(".")[0], F.round(kept["seed_pct"] * kept["n1"]), F.round(kept["query_pct"] * kept["n2"]), n1, n2))
    elif method == "logit":
        grouped = groups(cells, cells_of_interest=cells_of_interest) if rest else grouped
        r = kept.join(_per_feature(counts, grouped, kept, logit_p), ["pair", "feature"])
    else:
        if rest:
            labels = narrowed.select("barcode", F.lit("").alias("scope"), F.col("territory").cast("string").alias("label"))
        else:
            labels = grouped.select("barcode", F.col("pair").alias("scope"), F.when(F.col("side") == "seed", F.col("pair")).alias("label"))
        scoped = kept.withColumn("scope", F.lit("") if rest else F.col("pair"))
        model = count_models.shrunk_dispersion if method == "DESeq2" else count_models.quasi_likelihood
        r = model(counts, labels, scoped).withColumn("p_value", F.col("f_p" if method == "QLF" else "lr_p")).withColumn("fold_change", F.col("log2_fold"))
    adjust = benjamini_hochberg if method in ("DESeq2", "QLF", "LRT") else holm
    r = r.withColumn("p_value_adj", adjust("p_value", "pair", "feature"))
    r = r.where(F.col("p_value_adj") <= pval)
    return r.select(F.col("feature").alias("genes"), "p_value", "p_value_adj", "seed_pct", "query_pct", "fold_change", _values("effect", r["p_value"], r["n1"].cast("double"), r["n2"].cast("double")).alias("effect_size"), "seed", "query")
