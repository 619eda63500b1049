"""Queries on points, counts, normalisation and latent spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, embed, integrate, normalize, segment, spatial, tiling
from ..sources.bindings import CELLS, COUNTS, LATENT, POINTS, TERMS, events_points, latent_assay, retail_cells, retail_counts, term_counts
from .registry import query, rounded


@query(f"WITH {CELLS} SELECT barcode, x - min(x) OVER () + 1 AS x, y - min(y) OVER () + 1 AS y, x AS x_orig, y AS y_orig, CAST(1 AS INTEGER) AS z FROM cells")
def snap_coordinates(spark, sf):
    return normalize.snap(retail_cells(spark, sf))


@query(f"""WITH {CELLS}, d AS (SELECT a.barcode, min(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) AS d FROM cells a JOIN cells b ON a.barcode <> b.barcode GROUP BY 1)
SELECT quantile_cont(d, 0.999) AS scale FROM d""")
def nn_scale(spark, sf):
    return spatial.nn_scale(retail_cells(spark, sf))


@query(f"WITH {CELLS}, {COUNTS} SELECT barcode, x, y FROM cells WHERE barcode IN (SELECT barcode FROM counts)")
def barcode_intersection(spark, sf):
    return tiling.shared_barcodes(retail_cells(spark, sf).select("barcode", "x", "y"), retail_counts(spark, sf))[0]


@query(f"""WITH {POINTS}, k AS (SELECT *, round_even(x * 0.3, 0) AS gx, round_even(y * 0.3, 0) AS gy FROM points), n AS (SELECT gx, gy, count(*) AS n FROM k GROUP BY ALL)
SELECT barcode, x, y, label FROM k JOIN n USING (gx, gy) WHERE n > (SELECT quantile_cont(n, 0.01) FROM n)""")
def filter_grid(spark, sf):
    return tiling.filter_grid(events_points(spark, sf), 0.3)


@query(f"""WITH {CELLS}, k AS (SELECT barcode, round_even(x * 0.5, 0) + 1 AS x, round_even(y * 0.5, 0) + 1 AS y FROM cells)
SELECT CASE WHEN count(*) > 1 THEN string_agg(barcode || '_et_', '' ORDER BY barcode) ELSE min(barcode) END AS barcode, x, y, CAST(count(*) AS INTEGER) AS members FROM k GROUP BY x, y""")
def reduce_resolution(spark, sf):
    return tiling.reduce_resolution(retail_cells(spark, sf).select("barcode", "x", "y"), 0.5)


@query(f"""WITH {CELLS}, {COUNTS}, k AS (SELECT barcode, round_even(x * 0.5, 0) AS x, round_even(y * 0.5, 0) AS y FROM cells),
m AS (SELECT x, y, CASE WHEN count(*) > 1 THEN string_agg(barcode || '_et_', '' ORDER BY barcode) ELSE min(barcode) END AS cell, count(*) AS n FROM k GROUP BY x, y)
SELECT feature, cell AS barcode, round(sum(value) / any_value(n), 6) AS value FROM counts JOIN k USING (barcode) JOIN m USING (x, y) GROUP BY feature, cell""")
def adjust_counts(spark, sf):
    cells = tiling.reduce_resolution(retail_cells(spark, sf).select("barcode", "x", "y"), 0.5)
    return rounded(tiling.adjust_counts(retail_counts(spark, sf), cells), "value")


@query(f"WITH {COUNTS} SELECT feature, barcode, round(ln(1 + value / sum(value) OVER (PARTITION BY barcode) * 10000), 6) AS value FROM counts")
def log_norm(spark, sf):
    return rounded(normalize.log_norm(retail_counts(spark, sf)), "value")


@query(f"""WITH {CELLS}, {COUNTS}, g AS (SELECT f.feature, c.barcode, coalesce(k.value, 0) AS v FROM (SELECT DISTINCT feature FROM counts) f CROSS JOIN cells c LEFT JOIN counts k ON k.feature = f.feature AND k.barcode = c.barcode)
SELECT feature, barcode, round(least((v - avg(v) OVER (PARTITION BY feature)) / stddev_samp(v) OVER (PARTITION BY feature), 10), 6) AS value FROM g""")
def zscale(spark, sf):
    return rounded(normalize.zscale(retail_counts(spark, sf), retail_cells(spark, sf)), "value")


@query(f"""WITH {CELLS}, {COUNTS}, g AS (SELECT f.feature, coalesce(k.value, 0) AS v FROM (SELECT DISTINCT feature FROM counts) f CROSS JOIN cells c LEFT JOIN counts k ON k.feature = f.feature AND k.barcode = c.barcode),
m AS (SELECT feature, avg(v) AS mean, var_samp(v) AS var FROM g GROUP BY 1)
SELECT feature, round(mean, 6) AS mean, round(var, 5) AS var, CAST(row_number() OVER (ORDER BY var DESC, feature) AS INTEGER) AS rank FROM m ORDER BY rank LIMIT 10""")
def hvg_variance(spark, sf):
    """The ten features of largest variance: the count is the operator's own parameter."""
    out = normalize.variable_features(retail_counts(spark, sf), retail_cells(spark, sf).count(), 10)
    return out.select("feature", F.round("mean", 6).alias("mean"), F.round("var", 5).alias("var"), "rank")


@query(f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM documents), m AS (SELECT feature, sum(value) / any_value(n) AS mean, count(*) AS nnz, any_value(n) AS n FROM terms, n GROUP BY feature)
SELECT feature, round((sum(power(least((value - mean) / sqrt(mean), sqrt(n)), 2)) + (any_value(n) - any_value(nnz)) * any_value(mean)) / (any_value(n) - 1), 6) AS variance FROM terms JOIN m USING (feature) GROUP BY feature""")
def clipped_variance(spark, sf):
    """Variance of words' standardised, clipped counts around a given curve, that of Poisson counts."""
    c, n = term_counts(spark, sf), spark.read.parquet(f"{sf}/documents.parquet").count()
    m = normalize.moments(c, n).select("feature", "mean", F.sqrt("mean").alias("sd"))
    return rounded(normalize.clipped_variance(c, m, n), "variance")


@query()
def stabilised_features(spark, sf):
    """The hundred words of largest standardised variance: the count is the operator's own parameter."""
    return normalize.stabilised_features(term_counts(spark, sf), spark.read.parquet(f"{sf}/documents.parquet").count(), 100)


@query(f"""WITH {TERMS}, d AS (SELECT feature, count(*) AS df FROM terms GROUP BY 1)
SELECT feature, barcode, round(ln(1 + value / sum(value) OVER (PARTITION BY barcode) * (SELECT count(DISTINCT barcode) FROM terms) / df * 10000), 6) AS value FROM terms JOIN d USING (feature)""")
def tfidf(spark, sf):
    return rounded(normalize.tfidf(term_counts(spark, sf)), "value")


@query(f"""WITH {COUNTS}, m AS (SELECT *, sum(value) OVER (PARTITION BY feature) * sum(value) OVER (PARTITION BY barcode) / sum(value) OVER () AS mu FROM counts)
SELECT feature, barcode, round(greatest(-sqrt((SELECT count(*) FROM customer)), least(sqrt((SELECT count(*) FROM customer)), (value - mu) / sqrt(mu + mu * mu / 100))), 6) AS value FROM m""")
def pearson_residuals(spark, sf):
    return rounded(normalize.pearson_residuals(retail_counts(spark, sf), retail_cells(spark, sf).count()), "value")


_DIMS = f"WITH {LATENT}, d AS (SELECT barcode, CAST(unnest(range(1, len(vec) + 1)) AS INTEGER) AS dim, unnest(vec) AS v FROM latent)"


@query(f"{_DIMS} SELECT barcode, dim, round((v - min(v) OVER (PARTITION BY dim)) / (max(v) OVER (PARTITION BY dim) - min(v) OVER (PARTITION BY dim)), 6) AS value FROM d")
def min_max(spark, sf):
    return rounded(normalize.norm_dims(latent_assay(spark, sf), "minmax"), "value")


@query(f"{_DIMS} SELECT barcode, dim, round((v - avg(v) OVER (PARTITION BY dim)) / stddev_samp(v) OVER (PARTITION BY dim), 6) AS value FROM d")
def z_norm(spark, sf):
    return rounded(normalize.norm_dims(latent_assay(spark, sf), "z"), "value")


@query(f"""{_DIMS}, q AS (SELECT dim, quantile_cont(v, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]) AS q FROM d GROUP BY 1)
SELECT dim, CAST(unnest(range(1, 11)) AS INTEGER) AS i, round(unnest(q), 6) AS value FROM q""")
def quantile_norm(spark, sf):
    return rounded(normalize.quantile_norm(latent_assay(spark, sf), 10), "value")


_LOAD = "load AS (SELECT feature, CAST(d AS INTEGER) AS dim, ((length(feature) * 7 + ascii(right(feature, 1)) * d) % 11 - 5) / 10.0 AS loading FROM (SELECT DISTINCT feature FROM counts), range(1, 4) t(d))"


def _loadings(counts):
    d = F.col("dim")
    return counts.select("feature").distinct().withColumn("dim", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("loading", ((F.length("feature") * 7 + F.ascii(F.substring("feature", -1, 1)) * d) % 11 - 5) / F.lit(10.0))


@query(f"WITH {COUNTS}, {_LOAD} SELECT barcode, dim, round(sum(abs(loading)), 6) AS value FROM counts JOIN load USING (feature) WHERE value > 0 GROUP BY ALL")
def pca_loading_sum(spark, sf):
    c = retail_counts(spark, sf)
    return rounded(embed.loading_sum(c, _loadings(c)), "value")


@query(f"""WITH {COUNTS}, {_LOAD}, e AS (SELECT barcode, d AS dim, x / 39 * d AS value FROM (SELECT CAST(c_custkey AS VARCHAR) AS barcode, CAST(c_custkey % 40 AS DOUBLE) AS x FROM customer), range(1, 4) t(d)),
m AS (SELECT feature, sum(value) / (SELECT count(*) FROM customer) AS mean FROM counts GROUP BY 1)
SELECT feature, barcode, round(greatest(0, sum(e.value * loading) + any_value(mean)), 6) AS value FROM e JOIN load USING (dim) JOIN m USING (feature) GROUP BY feature, barcode""")
def back_infer(spark, sf):
    c, cells = retail_counts(spark, sf), retail_cells(spark, sf)
    e = cells.withColumn("dim", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("barcode", "dim", (F.col("x") / 39 * F.col("dim")).alias("value"))
    return rounded(integrate.back_infer(e, _loadings(c), normalize.moments(c, cells.count()).select("feature", "mean")), "value")


@query(f"""WITH {CELLS}, p AS (SELECT a.barcode AS center, b.barcode AS neighbor, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS dist FROM cells a, cells b)
SELECT center, neighbor, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY center ORDER BY dist, neighbor) AS INTEGER) AS rank FROM p QUALIFY rank <= 6""")
def knn_points(spark, sf):
    c = retail_cells(spark, sf)
    return rounded(spatial.knn_join(c, c, 6), "dist")


@query(f"""WITH {LATENT}, p AS (SELECT a.barcode AS center, b.barcode AS neighbor, round(list_distance(a.vec, b.vec), 12) AS dist FROM latent a, latent b)
SELECT center, neighbor, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY center ORDER BY dist, neighbor) AS INTEGER) AS rank FROM p QUALIFY rank <= 21""")
def knn_graph(spark, sf):
    return rounded(spatial.knn_graph(latent_assay(spark, sf), 21), "dist")


@query(f"""WITH {CELLS} SELECT a.barcode AS center, b.barcode AS neighbor, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS dist FROM cells a JOIN cells b ON abs(a.x - b.x) <= 2.5 AND abs(a.y - b.y) <= 2.5 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2.5""")
def radius_neighbors(spark, sf):
    c = retail_cells(spark, sf)
    return rounded(spatial.radius_join(c, c, 2.5), "dist")


@query(f"""WITH {CELLS}, box AS (SELECT max(x) AS mx, max(y) AS my FROM cells),
n AS (SELECT r, c, r * 7.0 / 6 * 0 + r * (my + 1) / 5 AS y, CASE WHEN r % 2 = 0 THEN -mx / 10 + c * (mx + mx / 5) / 6 ELSE c * mx / 5 END AS x FROM box, range(0, 6) a(r), range(0, 7) b(c) WHERE c <= CASE WHEN r % 2 = 0 THEN 6 ELSE 5 END)
SELECT CAST(r * 7 + c AS VARCHAR) AS node, round(n.x, 6) AS x, round(n.y, 6) AS y, arg_min(barcode, (sqrt(power(n.x - cells.x, 2) + power(n.y - cells.y, 2)), barcode)) AS barcode FROM n, cells GROUP BY r, c, n.x, n.y""")
def hex_grid(spark, sf):
    return rounded(spatial.hex_grid(retail_cells(spark, sf), 36), "x", "y")


@query(f"""{_DIMS}, s AS (SELECT max(sd) AS m FROM (SELECT stddev_samp(v) AS sd FROM d GROUP BY dim)), r AS (SELECT greatest((SELECT max(x) FROM latent), (SELECT max(y) FROM latent)) * 0.3 / m AS r FROM s)
SELECT barcode, round(vec[1] * r, 6) AS f1, round(vec[64] * r, 6) AS f64, x, y FROM latent, r""")
def slic_scaling(spark, sf):
    a = latent_assay(spark, sf)
    f, _ = segment.spatial_features(a.select("barcode", "vec"), a, 1, 0.3)
    n = F.size("vec")
    return f.select("barcode", F.round(F.col("vec")[0], 6).alias("f1"), F.round(F.element_at("vec", n - 2), 6).alias("f64"), F.element_at("vec", n - 1).alias("x"), F.element_at("vec", n).alias("y"))


@query(f"""WITH {LATENT}, d AS (SELECT barcode, segment, unnest(range(1, len(vec) + 1)) AS dim, unnest(vec) AS v FROM latent)
SELECT barcode, CAST(dim AS INTEGER) AS dim, round(avg(v) OVER (PARTITION BY segment, dim), 6) AS value FROM d""")
def segment_centroids(spark, sf):
    a = latent_assay(spark, sf)
    out = segment.centroids(a.select("barcode", "vec"), a.select("barcode", "segment"))
    return rounded(normalize._dims(out), "value")


_PAIR = f"WITH {LATENT}, a AS (SELECT barcode, vec FROM latent), b AS (SELECT barcode, list_reverse(vec) AS vec FROM latent)"


@query(f"{_PAIR} SELECT barcode, CAST(2 * i - 1 AS INTEGER) AS dim, round(a.vec[i], 6) AS value FROM a JOIN b USING (barcode), range(1, 65) t(i) UNION ALL SELECT barcode, CAST(2 * i AS INTEGER), round(b.vec[i], 6) FROM a JOIN b USING (barcode), range(1, 65) t(i)")
def interlace(spark, sf):
    a = latent_assay(spark, sf).select("barcode", "vec")
    return rounded(normalize._dims(integrate.interlace(a, a.withColumn("vec", F.reverse("vec")))), "value")


@query(f"{_PAIR} SELECT barcode, CAST(i AS INTEGER) AS dim, round((a.vec[i] + b.vec[i]) / 2, 6) AS value FROM a JOIN b USING (barcode), range(1, 65) t(i)")
def average_embed(spark, sf):
    a = latent_assay(spark, sf).select("barcode", "vec")
    return rounded(normalize._dims(integrate.average(a, a.withColumn("vec", F.reverse("vec")))), "value")


@query(f"""WITH {CELLS} SELECT barcode, 'matched' AS sample, territory AS territory_cell_type, CAST(cell_type AS INTEGER) AS mapped_cell_type, CAST(NULL AS VARCHAR) AS reference_territory FROM cells
UNION ALL SELECT barcode, 'reference', CAST(cell_type AS VARCHAR), NULL, territory FROM cells""")
def merge_territories(spark, sf):
    c = retail_cells(spark, sf).select("barcode", "territory", "cell_type")
    return integrate.merge_territories(c, c, "territory", "cell_type")


@query(f"WITH {COUNTS}, m AS (SELECT 'mod1_' || feature AS feature, barcode, value FROM counts UNION ALL SELECT 'mod2_' || feature, barcode, value FROM counts) SELECT * FROM m")
def joint_counts(spark, sf):
    c = retail_counts(spark, sf)
    return integrate.concat_counts(c, c)


def _embedding(kind, dims=5, normalization="log_norm"):
    def run(spark, sf):
        return embed.generate_embeddings(retail_counts(spark, sf), retail_cells(spark, sf), kind, normalization, dims, 20)

    return run


query(name="embed_pca")(_embedding("PCA"))
query(name="embed_pca_l")(_embedding("PCA_L"))
query(name="embed_lsi")(_embedding("LSI", normalization="TFIDF"))
query(name="embed_nmf")(_embedding("NMF"))
query(name="embed_umap")(_embedding("UMAP", 3))


@query()
def kmeans_segments(spark, sf):
    a = latent_assay(spark, sf)
    return segment.kmeans(a.select("barcode", "vec"), 10)


@query()
def som_segments(spark, sf):
    return segment.som(latent_assay(spark, sf).select("barcode", "vec"), 9, 5)


@query()
def louvain_segments(spark, sf):
    return segment.communities(latent_assay(spark, sf).select("barcode", "vec"), 10, 1.0)


@query()
def leiden_segments(spark, sf):
    return segment.communities(latent_assay(spark, sf).select("barcode", "vec"), 10, 1.0, "leiden")


@query()
def slic_superpixels(spark, sf):
    a = latent_assay(spark, sf)
    return segment.slic(a.select("barcode", "vec"), a, 20, iterations=5)[0]


@query()
def voronoi_tiles(spark, sf):
    return tiling.rasterise(tiling.voronoi(retail_cells(spark, sf)))


@query()
def integrate_counts(spark, sf):
    c = retail_counts(spark, sf)
    return integrate.integrate_counts(c, c.withColumn("barcode", F.concat(F.lit("r"), "barcode")), 20, 5)


@query()
def integrate_harmony(spark, sf):
    """Customers of even and odd nations as two samples."""
    c = retail_counts(spark, sf).join(retail_cells(spark, sf).select("barcode", "cell_type"), "barcode")
    part = lambda k: c.where(F.col("cell_type") % 2 == k).drop("cell_type")
    return integrate.integrate_counts(part(0), part(1), 20, 5, "HarmonyIntegration")


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings")
def knn_lists_recall(spark, sf):
    """Whether inverted lists find 95 of 100 of each vector's ten nearest vectors, against the exact join."""
    v = latent_assay(spark, sf).select("barcode", "vec")
    r = ann.recall(ann.nearest(v, v, 10), spatial.nearest_vectors(v, v, 10))
    return r.select("n_queries", (F.col("recall") >= 0.95).alias("enough"))


@query()
def louvain_superpixels(spark, sf):
    a = latent_assay(spark, sf)
    return segment.generate_spix(a.select("barcode", "vec"), a, "louvain_slic", 1.0)[0]


@query()
def concat_embed(spark, sf):
    c = retail_counts(spark, sf)
    return integrate.concat_embed(c, c, dims=5, n_features=30)


@query()
def integrate_assays(spark, sf):
    cells, c = retail_cells(spark, sf).drop("cell_type"), retail_counts(spark, sf)
    out = integrate.integrate_assays(cells, c, cells, c, 20, 5)
    return out["coordinates"].join(out["embedding"].drop("sample"), "barcode")
