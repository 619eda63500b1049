"""Two modalities or samples as one assay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def interlace(a: DataFrame, b: DataFrame, dims: int | None = None) -> DataFrame:
    """barcode, vec: a1, b1, a2, b2, ... of shared barcodes."""
    some = (lambda c: F.slice(c, 1, dims)) if dims else F.col
    return a.select("barcode", F.col("vec").alias("a")).join(b.select("barcode", F.col("vec").alias("b")), "barcode").select("barcode", F.flatten(F.zip_with(some("a"), some("b"), lambda x, y: F.array(x, y))).alias("vec"))


def average(a: DataFrame, b: DataFrame, dims: int | None = None) -> DataFrame:
    some = (lambda c: F.slice(c, 1, dims)) if dims else F.col
    return a.select("barcode", F.col("vec").alias("a")).join(b.select("barcode", F.col("vec").alias("b")), "barcode").select("barcode", F.zip_with(some("a"), some("b"), lambda x, y: (x + y) / 2).alias("vec"))


def concat_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both, features prefixed by mod1_ and mod2_, of shared barcodes."""
    shared = a.select("barcode").distinct().join(b.select("barcode").distinct(), "barcode", "left_semi")
    both = a.withColumn("feature", F.concat(F.lit("mod1_"), "feature")).unionByName(b.withColumn("feature", F.concat(F.lit("mod2_"), "feature")))
    return both.join(shared, "barcode", "left_semi")


def joint(a: DataFrame, b: DataFrame, method: str = "interlace", dims: int | None = None) -> DataFrame:
    if method in ("interlace", "mean"):
        return (interlace if method == "interlace" else average)(a, b, dims)
    raise ValueError(f"unknown method {method!r}: interlace, mean (concat: concat_embed)")


def concat_embed(a: DataFrame, b: DataFrame, normalization: str = "log_norm", dim_reduction: str = "PCA", dims: int = 30, n_features: int = 2000) -> DataFrame:
    """Both modalities' counts of shared barcodes, embedded together."""
    from .embed import generate_embeddings

    both = cut(concat_counts(a, b))
    return generate_embeddings(both, both.select("barcode").distinct(), dim_reduction, normalization, dims, n_features)


def back_infer(embeds: DataFrame, loadings: DataFrame, means: DataFrame) -> DataFrame:
    """feature, barcode, value: the embedding times the loadings plus the feature's mean, at least 0.
    embeds (barcode, dim, value), loadings (feature, dim, loading), means (feature, mean)."""
    s = embeds.join(loadings, "dim").groupBy("feature", "barcode").agg(F.sum(F.col("value") * F.col("loading")).alias("s"))
    return s.join(means, "feature").select("feature", "barcode", F.greatest(F.lit(0.0), F.col("s") + F.col("mean")).alias("value"))


def merge_coordinates(matched: DataFrame, reference: DataFrame) -> DataFrame:
    """barcode, x, y, sample; all but the first at one place are moved by 1 to 2, by hashes."""
    both = reference.select("barcode", "x", "y", F.lit("reference").alias("sample")).unionByName(matched.select("barcode", "x", "y", F.lit("matched").alias("sample")))
    k = F.row_number().over(W.partitionBy("x", "y").orderBy(F.desc("sample"), "barcode"))
    move = lambda c, s: F.when(F.col("k") > 1, F.col(c) + 1 + F.pmod(F.xxhash64("barcode", "sample", F.lit(s)), F.lit(1 << 20)) / float(1 << 20)).otherwise(F.col(c))
    return both.withColumn("k", k).select("barcode", move("x", 1).alias("x"), move("y", 2).alias("y"), "sample")


def merge_territories(matched: DataFrame, reference: DataFrame, label_matched: str, label_reference: str) -> DataFrame:
    """barcode, sample, merged label (of both sides in one column) and each side's other labels, prefixed."""
    name = f"{label_matched}_{label_reference}"
    m = matched.select("barcode", F.lit("matched").alias("sample"), F.col(label_matched).cast("string").alias(name), *[F.col(c).alias(f"mapped_{c}") for c in matched.columns if c not in ("barcode", label_matched)])
    r = reference.select("barcode", F.lit("reference").alias("sample"), F.col(label_reference).cast("string").alias(name), *[F.col(c).alias(f"reference_{c}") for c in reference.columns if c not in ("barcode", label_reference)])
    return m.unionByName(r, allowMissingColumns=True)


def integrate_counts(matched: DataFrame, reference: DataFrame, n_features: int = 2000, dims: int = 30, method: str = "CCA") -> DataFrame:
    """barcode, sample, vec, scaled to [0, 1]. CCA: canonical directions of the two samples' cross-covariance over shared
    variable features (whose number bounds what the driver decomposes). HarmonyIntegration: principal components of both
    samples together, corrected for the sample (harmony.correct)."""
    import numpy as np

    from .mapping import dense, shared_features
    from .normalize import log_norm, variable_features

    if method not in ("CCA", "CCAIntegration", "HarmonyIntegration"):
        raise ValueError(f"unknown method {method!r}")
    if method == "HarmonyIntegration":
        from .embed import generate_embeddings
        from .harmony import correct

        both = cut(matched.unionByName(reference))
        cells = cut(matched.select("barcode").distinct().withColumn("batch", F.lit("matched")).unionByName(reference.select("barcode").distinct().withColumn("batch", F.lit("reference"))))
        latent = generate_embeddings(both, cells.select("barcode"), "PCA", "log_norm", dims, n_features)
        return _scaled(correct(latent.join(cells, "barcode").select("barcode", "batch", "vec")).withColumnRenamed("batch", "sample"))
    a, b = cut(log_norm(matched)), cut(log_norm(reference))  # read some times from here on, and made once
    shared = shared_features(a, b)
    top = variable_features(a.unionByName(b), max(2, a.select("barcode").distinct().count() + b.select("barcode").distinct().count()), n_features).select("feature").join(shared, "feature", "left_semi")
    da, db = cut(dense(a, a.select("barcode").distinct(), top)), cut(dense(b, b.select("barcode").distinct(), top))
    size = len(da.first()["vec"])

    def gram(df: DataFrame) -> tuple:
        def part(frames):
            import pandas as pd

            n, s, g = 0, np.zeros(size), np.zeros((size, size))
            for f in frames:
                x = np.array(f["vec"].tolist())
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})

        rows = df.select("vec").mapInPandas(part, "n long, s array<double>, g array<double>").collect()
        n = sum(r["n"] for r in rows)
        m = sum(np.array(r["s"]) for r in rows) / n
        return m, sum(np.array(r["g"]).reshape(size, size) for r in rows) / n - np.outer(m, m)

    (ma, ca), (mb, cb) = gram(da), gram(db)
    u, _, _ = np.linalg.svd(ca @ cb)
    u = u[:, :dims]

    def project(mean, sample):
        def run(frames):
            import pandas as pd

            for f in frames:
                x = (np.array(f["vec"].tolist()) - mean) @ u
                yield pd.DataFrame({"barcode": f["barcode"], "sample": sample, "vec": x.tolist()})

        return run

    out = da.mapInPandas(project(ma, "matched"), "barcode string, sample string, vec array<double>").union(db.mapInPandas(project(mb, "reference"), "barcode string, sample string, vec array<double>"))
    return _scaled(out)


def _scaled(out: DataFrame) -> DataFrame:
    """barcode, sample, vec with each dimension scaled to [0, 1]; a constant one stays."""
    ends = out.select(F.posexplode("vec").alias("i", "v")).groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("e"))
    return out.crossJoin(F.broadcast(ends)).select("barcode", "sample", F.transform("vec", lambda v, i: F.when(F.col("e")[i]["hi"] > F.col("e")[i]["lo"], (v - F.col("e")[i]["lo"]) / (F.col("e")[i]["hi"] - F.col("e")[i]["lo"])).otherwise(v)).alias("vec"))


def integrate_assays(mapped: DataFrame, mapped_counts: DataFrame, reference: DataFrame, reference_counts: DataFrame, n_features: int = 2000, dims: int = 30, label_mapped: str = "territory", label_reference: str = "territory", method: str = "CCA") -> dict[str, DataFrame]:
    """coordinates, counts (matched barcodes prefixed by `m:`), embedding and territories of a mapped
    sample and its reference. mapped, reference: barcode, x, y and labels."""
    tag = lambda df: df.withColumn("barcode", F.concat(F.lit("m:"), "barcode"))
    m, mc = tag(mapped), tag(mapped_counts)
    labels = lambda df: df.drop("x", "y")
    return {
        "coordinates": merge_coordinates(m, reference),
        "counts": mc.unionByName(reference_counts),
        "embedding": integrate_counts(mc, reference_counts, n_features, dims, method),
        "territories": merge_territories(labels(m), labels(reference), label_mapped, label_reference),
    }
