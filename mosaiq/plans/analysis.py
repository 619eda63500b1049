"""Queries on markers, mapping and its metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import benjamini_hochberg, half_up, holm
from ..operators import blocks, count_models, mapping, markers, metrics, views
from ..session import cut
from ..sources.bindings import CELLS, COUNTS, LATENT, latent_assay, retail_cells, retail_counts
from .registry import query, rounded

GROUPS = "grp AS (SELECT s.territory AS pair, CASE WHEN c.territory = s.territory THEN 'seed' ELSE 'query' END AS side, s.territory AS seed, 'remaining' AS query, barcode FROM cells c, (SELECT DISTINCT territory FROM cells) s)"
DENSE = "dns AS (SELECT g.pair, g.side, f.feature, coalesce(k.value, 0) AS v FROM grp g CROSS JOIN (SELECT DISTINCT feature FROM counts) f LEFT JOIN counts k ON k.feature = f.feature AND k.barcode = g.barcode)"
MET = """met AS (SELECT pair, feature, pair AS seed, 'remaining' AS query, count(*) FILTER (side = 'seed') AS n1, count(*) FILTER (side = 'query') AS n2,
 count(*) FILTER (side = 'seed' AND v > 0) / count(*) FILTER (side = 'seed') AS seed_pct, count(*) FILTER (side = 'query' AND v > 0) / count(*) FILTER (side = 'query') AS query_pct,
 avg(v) FILTER (side = 'seed') AS m1, avg(v) FILTER (side = 'query') AS m2, var_samp(v) FILTER (side = 'seed') AS v1, var_samp(v) FILTER (side = 'query') AS v2 FROM dns GROUP BY pair, feature),
kept AS (SELECT *, m1 - m2 AS fold_change FROM met WHERE (seed_pct >= 0.05 OR query_pct >= 0.05) AND abs(m1 - m2) >= 0.25)"""
BASE = f"WITH {CELLS}, {COUNTS}, {GROUPS}, {DENSE}, {MET}"


def _kept(spark, sf):
    c, cells = retail_counts(spark, sf), retail_cells(spark, sf)
    return c, cells, markers.tested(markers.metrics_of_rest(c, cells))


@query(f"WITH {CELLS}, {GROUPS} SELECT * FROM grp")
def deg_groups(spark, sf):
    return markers.groups(retail_cells(spark, sf))


@query(f"{BASE} SELECT pair, feature, seed, query, n1, n2, round(seed_pct, 6) AS seed_pct, round(query_pct, 6) AS query_pct, round(m1 - m2, 6) AS fold_change FROM met")
def deg_metrics(spark, sf):
    m = markers.metrics_of_rest(retail_counts(spark, sf), retail_cells(spark, sf))
    return rounded(m.select("pair", "feature", "seed", "query", "n1", "n2", "seed_pct", "query_pct", "fold_change"), "seed_pct", "query_pct", "fold_change")


_RANK = f"""{BASE}, r AS (SELECT d.*, rank() OVER (PARTITION BY pair, feature ORDER BY v) + (count(*) OVER (PARTITION BY pair, feature, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY pair, feature, v) AS t FROM dns d JOIN kept USING (pair, feature)),
s AS (SELECT pair, feature, sum(rk) FILTER (side = 'seed') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY 1, 2),
w AS (SELECT k.*, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS w, CAST(n1 AS DOUBLE) * n2 / 2 AS mid, sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))) AS sd FROM s JOIN kept k USING (pair, feature)),
z AS (SELECT *, CASE WHEN sd > 0 THEN (w - mid - sign(w - mid) * 0.5) / sd ELSE 0 END AS z FROM w)"""


@query(f"{_RANK} SELECT pair, feature, seed, query, round(seed_pct, 6) AS seed_pct, round(query_pct, 6) AS query_pct, round(fold_change, 6) AS fold_change, round(w, 3) AS w, round(z, 6) AS z FROM z")
def markers_rank_sum(spark, sf):
    out = markers.rank_sum_of_rest(*_kept(spark, sf)).select("pair", "feature", "seed", "query", "seed_pct", "query_pct", "fold_change", "w", "z")
    return rounded(rounded(out, "seed_pct", "query_pct", "fold_change", "z"), "w", digits=3)


@query(f"""{BASE}, t AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM kept)
SELECT pair, feature, round((m1 - m2) / sqrt(a + b), 6) AS t, round(power(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM t""")
def markers_welch(spark, sf):
    return rounded(rounded(markers.welch(_kept(spark, sf)[2]).select("pair", "feature", "t", "df"), "t"), "df", digits=4)


@query(f"""{_RANK}, p AS (SELECT pair, feature, least(1, 2 * exp(-z * z / 2)) AS p FROM z), n AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY p, feature) AS i FROM p)
SELECT pair, feature, round(p, 6) AS p, round(max(least(1, (n - i + 1) * p)) OVER (PARTITION BY pair ORDER BY p, feature), 6) AS p_adj FROM n""")
def holm_adjust(spark, sf):
    """Holm's adjustment of an upper bound of the rank-sum test's p-values, which both engines can compute."""
    r = markers.rank_sum_of_rest(*_kept(spark, sf)).select("pair", "feature", F.least(F.lit(1.0), 2 * F.exp(-F.col("z") * F.col("z") / 2)).alias("p"))
    return rounded(r.withColumn("p_adj", holm("p", "pair", "feature")), "p", "p_adj")


#: Two-sided normal tail of z as SQL: the series of all positive terms, exact to 1e-13; nothing is left beyond 8.
_TAIL = "CASE WHEN {z} = 0 THEN 1 WHEN {z} > 8 THEN 0 ELSE 1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln({z}) + n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"
#: The effect size by |z|, where the p-value is that of z; p counts from 1e-100 to 0.8.
_EFFECT = "round((least(greatest({z}, 0.2533471031357997), 21.273453560965855) + 0.8416212335729143) * sqrt((n1 + n2) / (CAST(n1 AS DOUBLE) * n2)), 6)"


def _adjusted(p: str, effect: str = "") -> str:
    """The result of identify_markers from a table p (kept, p) by Holm's adjustment."""
    return f"""{p}, o AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY p, feature) AS i FROM p)
SELECT feature AS genes, round(p, 8) AS p_value, round(max(least(1, (n - i + 1) * p)) OVER (PARTITION BY pair ORDER BY p, feature), 6) AS p_value_adj, round(seed_pct, 6) AS seed_pct, round(query_pct, 6) AS query_pct, round(fold_change, 6) AS fold_change, {effect} seed, query FROM o"""


def _markers(method, effect=True):
    def run(spark, sf):
        out = markers.identify_markers(retail_counts(spark, sf), retail_cells(spark, sf), method=method, pval=1.0)
        out = rounded(rounded(out, "p_value_adj", "seed_pct", "query_pct", "fold_change", "effect_size"), "p_value", digits=8)
        return out if effect else out.drop("effect_size")

    return run


_SHARES = "k AS (SELECT *, CAST(round(seed_pct * n1) AS BIGINT) AS a, CAST(round(query_pct * n2) AS BIGINT) AS b FROM kept)"
_LG = "lgamma({} + 1)".format
_HYPER = "exp(" + " + ".join(map(_LG, ("n1", "n2", "(a + b)", "(n1 + n2 - a - b)"))) + " - " + " - ".join(map(_LG, ("(n1 + n2)", "{x}", "(n1 - {x})", "(a + b - {x})", "(n2 - a - b + {x})"))) + ")"
_MARKER_SQL = {
    "markers_wilcox": _adjusted(f"{_RANK}, p AS (SELECT *, {_TAIL.format(z='abs(z)')} AS p FROM z)", _EFFECT.format(z="abs(z)") + " AS effect_size,"),
    "markers_chisq": _adjusted(f"""{BASE}, {_SHARES}, x AS (SELECT *, CASE WHEN a + b IN (0, n1 + n2) THEN 0 ELSE sqrt((n1 + n2) * power(greatest(0, abs(a * (n2 - b) - b * (n1 - a)) - (n1 + n2) / 2), 2) / (CAST(n1 AS DOUBLE) * n2 * (a + b) * (n1 + n2 - a - b))) END AS z FROM k),
p AS (SELECT *, {_TAIL.format(z="z")} AS p FROM x)""", _EFFECT.format(z="z") + " AS effect_size,"),
    # the integral of Student's density by Simpson's rule in the angle whose tangent is t / sqrt(df)
    "markers_ttest_p": _adjusted(f"""{BASE}, w AS (SELECT *, abs(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df FROM kept), h AS (SELECT *, atan(t / sqrt(df)) / 2000 AS h FROM w),
p AS (SELECT *, greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * h / 3 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(cos(i * h), df - 1)))) AS p FROM h)"""),
    "markers_fisher_p": _adjusted(f"""{BASE}, {_SHARES}, p AS (SELECT *, least(1, list_sum(list_filter(list_transform(range(greatest(0, a + b - n2), least(n1, a + b) + 1), lambda x: {_HYPER.format(x="x")}), lambda q: q <= {_HYPER.format(x="a")} * (1 + 1e-7)))) AS p FROM k)"""),
}
for _name, _method in (("markers_wilcox", "wilcox"), ("markers_ttest", "t.test"), ("markers_chisq", "chisq"), ("markers_fisher", "fisher.exact"), ("markers_logit", "logit"), ("markers_nb_lrt", "LRT"), ("markers_qlf", "QLF"), ("markers_deseq2", "DESeq2")):
    query(_MARKER_SQL.get(_name), name=_name)(_markers(_method))
for _name, _method in (("markers_ttest_p", "t.test"), ("markers_fisher_p", "fisher.exact")):
    query(_MARKER_SQL[_name], name=_name)(_markers(_method, effect=False))


@query(f"""WITH {CELLS}, {COUNTS}, v AS (SELECT feature, barcode, value, sum(value) OVER c AS total, count(*) OVER c AS m, row_number() OVER (PARTITION BY barcode ORDER BY value, feature) AS i, (SELECT count(DISTINCT feature) FROM counts) AS g FROM counts WINDOW c AS (PARTITION BY barcode)),
q AS (SELECT barcode, total, coalesce(max(value / total) FILTER (g - m + i - 1 = floor(0.75 * (g - 1))), 0) AS lo, coalesce(max(value / total) FILTER (g - m + i - 1 = ceil(0.75 * (g - 1))), 0) AS hi, max(0.75 * (g - 1) - floor(0.75 * (g - 1))) AS w, sum(sqrt(value)) AS roots FROM v GROUP BY barcode, total),
p AS (SELECT *, lo + w * (hi - lo) AS q FROM q),
r AS (SELECT barcode, total FROM p ORDER BY CASE WHEN (SELECT count(*) FILTER (q < 1e-20) * 2 > count(*) FROM p) THEN -roots ELSE abs(q - (SELECT avg(q) FROM p)) END, barcode LIMIT 1),
x AS (SELECT c.barcode, log2((c.value / p.total) / (k.value / r.total)) AS ratio, (log2(c.value / p.total) + log2(k.value / r.total)) / 2 AS s, (p.total - c.value) / p.total / c.value + (r.total - k.value) / r.total / k.value AS var
  FROM counts c JOIN p ON p.barcode = c.barcode CROSS JOIN r JOIN counts k ON k.barcode = r.barcode AND k.feature = c.feature),
y AS (SELECT *, rank() OVER (PARTITION BY barcode ORDER BY round(ratio, 9)) + (count(*) OVER (PARTITION BY barcode, round(ratio, 9)) - 1) / 2 AS by_ratio, rank() OVER (PARTITION BY barcode ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY barcode, round(s, 9)) - 1) / 2 AS by_s, count(*) OVER (PARTITION BY barcode) AS n FROM x),
f AS (SELECT barcode, CASE WHEN max(abs(ratio)) < 1e-6 THEN 0 ELSE sum(ratio / var) FILTER (k) / sum(1 / var) FILTER (k) END AS f
  FROM (SELECT *, by_ratio BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND by_s BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) AND var > 0 AS k FROM y) GROUP BY barcode)
SELECT p.barcode, round(p.total, 2) AS total, round(power(2.0, coalesce(f, 0) - avg(coalesce(f, 0)) OVER ()), 6) AS factor FROM p LEFT JOIN f ON f.barcode = p.barcode""")
def tmm_factors(spark, sf):
    """Library sizes of customers and their trimmed-mean factors."""
    return rounded(rounded(count_models.trimmed_mean_factors(retail_counts(spark, sf)), "factor"), "total", digits=2)


@query(f"""WITH {CELLS}, {COUNTS}, g AS (SELECT feature, barcode, ln(1 + floor(value)) AS lg FROM counts JOIN cells USING (barcode)), m AS (SELECT feature, sum(lg) / (SELECT count(*) FROM cells) AS mean FROM g GROUP BY feature)
SELECT c.barcode, round(exp(median(coalesce(lg, 0) - mean)), 6) AS factor FROM cells c CROSS JOIN m LEFT JOIN g ON g.feature = m.feature AND g.barcode = c.barcode GROUP BY c.barcode""")
def size_factors(spark, sf):
    """Customers' size factors by medians of ratios."""
    return rounded(count_models.median_ratio_factors(retail_counts(spark, sf), retail_cells(spark, sf)), "factor")


@query(f"""WITH RECURSIVE v AS (SELECT CAST(c_nationkey AS VARCHAR) AS pair, c_mktsegment = 'BUILDING' AS seed, round(c_acctbal + 1000, 2) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
s AS (SELECT pair, count(*) FILTER (seed) AS n1, count(*) FILTER (NOT seed) AS n2, count(*) > count(DISTINCT v) AS ties FROM v GROUP BY pair),
r AS (SELECT pair, seed, rank() OVER (PARTITION BY pair ORDER BY v) + (count(*) OVER (PARTITION BY pair, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY pair, v) AS t FROM v),
w AS (SELECT s.*, (SELECT sum(r) FROM r WHERE r.pair = s.pair AND seed) - n1 * (n1 + 1) / 2 AS w, (SELECT sum(CAST(t AS DOUBLE) * t - 1) FROM r WHERE r.pair = s.pair) AS tied FROM s WHERE n1 > 0 AND n2 > 0),
-- one cell after the other is taken into the seed side or not: ways by cells seen, cells taken and their rank sum
e AS (SELECT 0 AS i, 0 AS k, 0 AS total, 1.0::DOUBLE AS ways UNION ALL SELECT i, k, total, sum(ways) AS ways FROM (SELECT i + 1 AS i, k + b AS k, total + b * (i + 1) AS total, ways FROM e, (VALUES (0), (1)) z(b) WHERE i < (SELECT coalesce(max(n1 + n2), 0) FROM w WHERE n1 < 50 AND n2 < 50 AND NOT ties) AND k + b < 50) GROUP BY i, k, total),
x AS (SELECT pair, least(1, 2 * sum(ways) FILTER (CASE WHEN w > CAST(n1 AS DOUBLE) * n2 / 2 THEN total - n1 * (n1 + 1) / 2 >= w ELSE total - n1 * (n1 + 1) / 2 <= w END) / sum(ways)) AS p FROM w JOIN e ON e.i = n1 + n2 AND e.k = n1 WHERE n1 < 50 AND n2 < 50 AND NOT ties GROUP BY pair),
z AS (SELECT *, abs((w - CAST(n1 AS DOUBLE) * n2 / 2 - sign(w - CAST(n1 AS DOUBLE) * n2 / 2) * 0.5) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - tied / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))))) AS z FROM w)
SELECT z.pair, n1, n2, round(w, 1) AS w, round(coalesce(x.p, {_TAIL.format(z="z")}), 8) AS p_value FROM z LEFT JOIN x ON x.pair = z.pair""")
def markers_wilcox_exact(spark, sf):
    """Account balances of two segments within each nation: exact p-values under 50 cells a side without ties, else normal."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey").cast("string").alias("barcode")
    counts = c.select(F.lit("balance").alias("feature"), k, F.round(F.col("c_acctbal") + 1000, 2).cast("double").alias("value"))
    grouped = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("c_nationkey").cast("string").alias("pair"), F.when(F.col("c_mktsegment") == "BUILDING", "seed").otherwise("query").alias("side"), F.lit("BUILDING").alias("seed"), F.lit("MACHINERY").alias("query"), k)
    r = markers.rank_sum(counts, grouped, markers.metrics(counts, grouped, 1)).select("pair", "n1", "n2", "w", markers.rank_sum_p().alias("p_value"))
    return rounded(rounded(r, "p_value", digits=8), "w", digits=1)


@query(f"""WITH {CELLS}, {COUNTS} SELECT DISTINCT feature FROM counts JOIN cells USING (barcode) WHERE territory = 'BUILDING' INTERSECT SELECT feature FROM counts JOIN cells USING (barcode) WHERE territory <> 'BUILDING'""")
def shared_signal(spark, sf):
    c = retail_counts(spark, sf).join(retail_cells(spark, sf).select("barcode", "territory"), "barcode")
    return mapping.shared_features(c.where("territory = 'BUILDING'"), c.where("territory <> 'BUILDING'"))


SEED = f"{LATENT}, sd AS (SELECT * FROM latent WHERE segment < 5), qr AS (SELECT * FROM latent WHERE segment >= 5)"
CORR = f"""{SEED}, st AS (SELECT barcode, vec, list_sum(vec) / len(vec) AS m FROM latent), ct AS (SELECT barcode, list_transform(vec, lambda x: x - m) AS c FROM st),
un AS (SELECT barcode, c, sqrt(list_dot_product(c, c)) AS n, len(c) AS k FROM ct),
pr AS (SELECT q.barcode AS query, s.barcode AS seed, list_dot_product(q.c, s.c) / (q.n * s.n) AS r, q.k FROM un q, un s WHERE q.barcode IN (SELECT barcode FROM qr) AND s.barcode IN (SELECT barcode FROM sd))"""


def _sides(spark, sf):
    """Two samples of the latent assay: the segments under five, and the others."""
    a = latent_assay(spark, sf)
    return a.where("segment < 5"), a.where("segment >= 5")


@query(f"WITH {CORR} SELECT query, seed, round(r * (k - 1) / k, 4) AS score FROM pr")
def pearson_approx(spark, sf):
    s, q = _sides(spark, sf)
    kind = {"score": blocks.correlation("vec", lambda n: (n - 1) / n)}
    return blocks.Scores(q.select("barcode", "vec"), s.select("barcode", "vec"), kind, 4).table().drop("kind")


@query(f"WITH {CORR} SELECT query, seed, round(r, 4) AS score FROM pr")
def pearson_exact(spark, sf):
    return _scores(spark, sf, "feature").table().drop("kind")


def _sets(spark, sf):
    return retail_counts(spark, sf).where("value >= 60").groupBy("barcode").agg(F.collect_set("feature").alias("items"))


@query(f"""WITH {COUNTS}, t AS (SELECT barcode, feature, count(*) OVER (PARTITION BY barcode) AS n FROM counts WHERE value >= 60)
SELECT a.barcode AS query, b.barcode AS seed, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS score FROM t a JOIN t b USING (feature) WHERE a.barcode IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING') AND b.barcode IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1, 2""")
def jaccard_sets(spark, sf):
    s, c = cut(_sets(spark, sf)), retail_cells(spark, sf)
    of = lambda t: s.join(c.where(F.col("territory") == t), "barcode", "left_semi")
    return mapping.jaccard(of("BUILDING"), of("MACHINERY"), 6)


@query(f"""WITH {CELLS}, {COUNTS}, p AS (SELECT a.barcode AS center, b.barcode AS neighbor FROM cells a, cells b QUALIFY row_number() OVER (PARTITION BY a.barcode ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.barcode) <= 6)
SELECT feature, center AS barcode, round(sum(value) / 6, 6) AS value FROM p JOIN counts ON barcode = neighbor GROUP BY ALL""")
def knn_niche(spark, sf):
    return rounded(mapping.niche_signal(retail_counts(spark, sf), mapping.neighborhoods(retail_cells(spark, sf), "knn", 6)), "value")


_NEAR = "p AS (SELECT a.barcode AS center, b.barcode AS neighbor, count(*) OVER (PARTITION BY a.barcode) AS n FROM cells a JOIN cells b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 1.5)"


@query(f"WITH {CELLS}, {COUNTS}, {_NEAR} SELECT feature, center AS barcode, round(sum(value) / any_value(n), 6) AS value FROM p JOIN counts ON barcode = neighbor GROUP BY ALL")
def radius_niche(spark, sf):
    return rounded(mapping.niche_signal(retail_counts(spark, sf), mapping.neighborhoods(retail_cells(spark, sf), "radius", radius=1.5)), "value")


@query(f"""WITH {LATENT}, p AS (SELECT a.barcode AS center, b.vec AS vec, count(*) OVER (PARTITION BY a.barcode) AS n FROM latent a JOIN latent b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 1.5)
SELECT 'dim_' || lpad(CAST(i AS VARCHAR), 5, '0') AS feature, center AS barcode, round(sum(v) / any_value(n), 6) AS value FROM (SELECT center, n, unnest(vec) AS v, unnest(range(1, len(vec) + 1)) AS i FROM p) GROUP BY i, center""")
def embedding_niche(spark, sf):
    """Embeddings as the signal of neighbourhoods: means of each dimension over the cells around."""
    a = latent_assay(spark, sf)
    return rounded(mapping.niche_signal(mapping.embedding_signal(a), mapping.neighborhoods(a, "radius", radius=1.5)), "value")


@query(f"""WITH {CELLS}, {COUNTS} SELECT territory, feature, round(sum(value) / any_value(n), 6) AS value FROM counts JOIN cells USING (barcode) JOIN (SELECT territory, count(*) AS n FROM cells GROUP BY 1) USING (territory) GROUP BY ALL""")
def territory_niche(spark, sf):
    return rounded(mapping.territory_signal(retail_counts(spark, sf), retail_cells(spark, sf)), "value")


@query(f"""WITH RECURSIVE {CELLS}, e AS (SELECT a.barcode AS a, b.barcode AS b FROM cells a JOIN cells b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
h AS (SELECT barcode AS center, barcode AS neighbor, 0 AS d FROM cells UNION SELECT center, b, d + 1 FROM h JOIN e ON neighbor = a WHERE d < 2)
SELECT center, neighbor, CAST(min(d) AS INTEGER) AS hops FROM h GROUP BY 1, 2""")
def graph_neighbors(spark, sf):
    """Two steps on the lattice's graph of neighbours at distance 1."""
    from ..operators.spatial import hops, radius_join

    c = retail_cells(spark, sf)
    e = radius_join(c, c, 1.0).where("dist = 1").select(F.col("center").alias("a"), F.col("neighbor").alias("b"))
    return hops(e, c, 2)


_COMP = f"{CELLS}, {_NEAR}, comp AS (SELECT center AS barcode, cell_type AS label, count(*) AS n, any_value(n) AS size FROM p JOIN cells ON barcode = neighbor GROUP BY center, cell_type)"


def _composition(spark, sf):
    c = retail_cells(spark, sf)
    return mapping.composition(c, mapping.neighborhoods(c, "radius", radius=1.5))


@query(f"""WITH {_COMP}, q AS (SELECT comp.*, territory FROM comp JOIN cells USING (barcode))
SELECT a.barcode AS query, b.barcode AS seed, round(sum(least(a.n, b.n)) / (any_value(a.size) + any_value(b.size) - sum(least(a.n, b.n))), 6) AS score FROM q a JOIN q b ON a.label = b.label WHERE a.territory = 'BUILDING' AND b.territory = 'MACHINERY' GROUP BY 1, 2""")
def composition_jaccard(spark, sf):
    c = cut(_composition(spark, sf).join(retail_cells(spark, sf).select("barcode", "territory"), "barcode"))
    return mapping.composition_jaccard(c.where("territory = 'BUILDING'"), c.where("territory = 'MACHINERY'"), 6)


@query(f"WITH {CELLS} SELECT a.barcode AS query, b.barcode AS seed, CAST(1 AS DOUBLE) AS score FROM cells a JOIN cells b USING (cell_type) WHERE a.territory = 'BUILDING' AND b.territory = 'MACHINERY'")
def cell_type_match(spark, sf):
    c = retail_cells(spark, sf)
    return mapping.cell_type_match(c.where("territory = 'BUILDING'"), c.where("territory = 'MACHINERY'"))


COSTS = f"""{CORR}, sm AS (SELECT query, seed, round(r, 4) AS score FROM pr), cs AS (SELECT 'feature' AS kind, query, seed, score FROM sm
UNION ALL SELECT 'niche', query, seed, round(exp(-sqrt(power(q.x - s.x, 2) + power(q.y - s.y, 2)) / 5), 4) FROM sm JOIN qr q ON q.barcode = query JOIN sd s ON s.barcode = seed)"""


def _scores(spark, sf, *kinds):
    """Two kinds of score, or some of them: exact correlation, and closeness on the lattice."""
    s, q = _sides(spark, sf)
    both = blocks.Scores(q.select("barcode", "vec", "x", "y"), s.select("barcode", "vec", "x", "y"), {"feature": blocks.correlation("vec"), "niche": blocks.closeness(5)}, 4)
    return both.of(kinds=list(kinds)) if kinds else both


_GOOD = "gd AS (SELECT query FROM (SELECT query, kind, max(score) AS m FROM cs GROUP BY 1, 2) GROUP BY query HAVING bool_and(m > 0.3))"


@query(f"WITH {COSTS}, {_GOOD} SELECT kind, query, seed, round(score, 4) AS score FROM cs WHERE query IN (SELECT query FROM gd)")
def filter_cost(spark, sf):
    return mapping.filter_cost(_scores(spark, sf), 0.3).table()


@query(f"WITH {COSTS} SELECT query, seed, round(sum(1 - score), 4) AS cost FROM cs GROUP BY 1, 2")
def total_cost(spark, sf):
    return mapping.total_cost(_scores(spark, sf), decimals=4)


@query(f"""WITH {_COMP}, qs AS (SELECT q.barcode AS query, s.barcode AS seed, round(exp(-sqrt(power(q.x - s.x, 2) + power(q.y - s.y, 2)) / 5), 4) AS near, CASE WHEN q.cell_type = s.cell_type THEN 1 ELSE 0 END AS same FROM cells q, cells s WHERE q.territory = 'BUILDING' AND s.territory = 'MACHINERY'),
m AS (SELECT a.barcode AS query, b.barcode AS seed, sum(least(a.n, b.n)) / (any_value(a.size) + any_value(b.size) - sum(least(a.n, b.n))) AS score FROM comp a JOIN comp b USING (label) GROUP BY 1, 2)
SELECT query, seed, round(3 - near - same - coalesce(score, 0), 6) AS cost FROM qs LEFT JOIN m USING (query, seed)""")
def total_cost_sparse(spark, sf):
    """A dense kind of score and two that leave out pairs of score 0, which cost 1 there."""
    c = retail_cells(spark, sf)
    cells = cut(c.join(mapping.composition_rows(_composition(spark, sf)), "barcode", "left"))
    place = lambda q, s: (lambda at: lambda i, j: half_up(at(i, j), 4))(blocks.closeness(5)(q, s))
    kinds = {"feature": place, "composition": blocks.common_counts(), "cell_type": blocks.same("cell_type")}
    return mapping.total_cost(blocks.Scores(cells.where("territory = 'BUILDING'"), cells.where("territory = 'MACHINERY'"), kinds), decimals=6)


_BEST = f"""{COSTS}, tc AS (SELECT query, seed, round(sum(1 - score), 4) AS cost FROM cs GROUP BY 1, 2),
bm AS (SELECT query AS "from", seed AS "to", 1 AS epoch, cost FROM tc QUALIFY row_number() OVER (PARTITION BY query ORDER BY cost, seed) = 1)"""


def _best(spark, sf):
    """Each query's seed of least cost, with its scores."""
    found = _scores(spark, sf).best(4)
    return found.select(F.col("query").alias("from"), F.col("seed").alias("to"), F.lit(1).alias("epoch"), "cost", "feature", "niche")


@query(f"WITH {_BEST} SELECT * FROM bm")
def best_match(spark, sf):
    return mapping.best_match(_best(spark, sf).drop("feature", "niche"))


@query(f"""WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY cost, "from", "to") AS a, row_number() OVER (PARTITION BY "to" ORDER BY cost, "from", "to") AS b FROM bm)
SELECT "from", "to", epoch, cost FROM r WHERE a = 1 AND b = 1""")
def dedupe_map(spark, sf):
    return mapping.dedupe(_best(spark, sf).drop("feature", "niche"))


@query(f"""WITH {_BEST} SELECT "from", "to", epoch, cost, max(score) FILTER (kind = 'feature') AS feature, max(score) FILTER (kind = 'niche') AS niche FROM bm JOIN cs ON query = "from" AND seed = "to" GROUP BY ALL""")
def score_matches(spark, sf):
    best = cut(_best(spark, sf))
    return mapping.score_matches(best.drop("feature", "niche"), mapping.listed(best, ["feature", "niche"], "from", "to"))


@query(f"""WITH {CORR}, t AS (SELECT query, seed FROM (SELECT query, seed, round(r, 4) AS score FROM pr) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, seed) <= 10)
SELECT a.query AS a, b.query AS b, round(1 - count(*) / (20 - count(*)), 6) AS distance FROM t a JOIN t b USING (seed) WHERE a.query < b.query GROUP BY 1, 2""")
def overlap_distance(spark, sf):
    return rounded(metrics.top_overlap(_scores(spark, sf, "feature"), 10), "distance")


@query(f"""WITH {COSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score) AS i FROM cs)
SELECT kind AS metric, round(var_samp(score) / avg(score), 4) AS dispersion, round(stddev_samp(score) / avg(score), 4) AS cv, round(2 * sum(i * score) / (count(*) * sum(score)) - (count(*) + 1) / count(*), 4) AS gini,
 round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 4) AS iqr, round(max(score) - min(score), 4) AS "range", round(sum(score) / sum(sum(score)) OVER (), 4) AS poc FROM r GROUP BY kind""")
def cost_contribution(spark, sf):
    return rounded(metrics.contribution(_scores(spark, sf)), "dispersion", "cv", "gini", "iqr", "range", "poc", digits=4)


@query()
def lap_mapping(spark, sf):
    return mapping.assign_cells(_scores(spark, sf), 200, 2).select("from", "to", "epoch", "cost")


@query(f"""WITH {COSTS}, tc AS (SELECT query, seed, round(sum(1 - score), 4) AS cost FROM cs GROUP BY 1, 2), m AS (SELECT query, epoch, min(cost) AS cost FROM tc, range(1, 4) t(epoch) WHERE seed % 3 < epoch GROUP BY 1, 2),
b AS (SELECT query, epoch, min(cost) OVER (PARTITION BY query ORDER BY epoch) AS cost FROM m) SELECT CAST(epoch AS INTEGER) AS epoch, round(avg(cost), 5) AS cost FROM b GROUP BY epoch""")
def cost_by_epoch(spark, sf):
    """Epochs in which ever more seeds are on offer; each query's best match so far counts."""
    a = _scores(spark, sf)
    thirds = blocks.Scores(a.query, a.seed.withColumn("third", F.col("barcode") % 3), a.kinds, 4).best(4, "third")
    m = thirds.withColumn("epoch", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("third < epoch")
    return rounded(mapping.cost_by_epoch(m.select(F.col("query").alias("from"), F.col("seed").alias("to"), "epoch", "cost")), "cost", digits=5)


@query()
def map_assays(spark, sf):
    c, k = retail_cells(spark, sf), retail_counts(spark, sf)
    s, q = c.where("territory = 'BUILDING'"), c.where("territory = 'MACHINERY'")
    of = lambda d: k.join(d.select("barcode"), "barcode", "left_semi")
    return mapping.map_assays(s, of(s), q, of(q), ("feature", "niche", "composition"), k=6, batch_size=200, threshold=0.0)[0]


@query()
def map_clusters(spark, sf):
    s, q = _sides(spark, sf)
    return metrics.clusters(mapping.similar(q, s), 10)


@query(f"""WITH {CELLS}, {COUNTS}, g AS (SELECT feature, barcode, x, y, territory, coalesce(value, 0) AS v FROM cells CROSS JOIN (SELECT unnest(['Brand#11', 'Brand#23']) AS feature) LEFT JOIN counts USING (feature, barcode)),
l AS (SELECT *, round(avg(v) OVER (PARTITION BY feature, territory), 9) AS m FROM g)
SELECT feature, barcode, x, y, territory, round((m - min(m) OVER (PARTITION BY feature)) / (max(m) OVER (PARTITION BY feature) - min(m) OVER (PARTITION BY feature)), 5) AS value FROM l WHERE feature IN (SELECT feature FROM counts)""")
def gene_expression_layer(spark, sf):
    return rounded(views.gene_expression(retail_counts(spark, sf), retail_cells(spark, sf), ["Brand#11", "Brand#23"], as_layer=True), "value", digits=5)


@query(f"WITH {CELLS} SELECT barcode, x, y FROM cells WHERE territory = 'BUILDING' OR barcode IN ('1', '2', '3')")
def filter_assay(spark, sf):
    from ..assay import SpatialAssay

    c = retail_cells(spark, sf)
    a = SpatialAssay.build(c.select("barcode", "x", "y"), retail_counts(spark, sf), scale=1.0, sparse=True).add_trial("Territory", c.select("barcode", F.col("territory").alias("label")))
    return a.filtered(cells=["1", "2", "3"], territories=["BUILDING"]).get_coordinates(original=True)


@query(f"WITH {CELLS} SELECT territory AS label, count(*) AS n FROM cells GROUP BY 1")
def territory_summary(spark, sf):
    return retail_cells(spark, sf).groupBy(F.col("territory").alias("label")).agg(F.count("*").alias("n"))


@query(f"""{_RANK}, p AS (SELECT pair, feature, least(1, 2 * exp(-z * z / 2)) AS p FROM z), n AS (SELECT *, count(*) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY p, feature) AS i FROM p)
SELECT pair, feature, round(min(least(1, n / i * p)) OVER (PARTITION BY pair ORDER BY p DESC, feature DESC), 6) AS p_adj FROM n""")
def bh_adjust(spark, sf):
    """The false discovery rate's adjustment of the same bounds as holm_adjust."""
    r = markers.rank_sum_of_rest(*_kept(spark, sf)).select("pair", "feature", F.least(F.lit(1.0), 2 * F.exp(-F.col("z") * F.col("z") / 2)).alias("p"))
    return rounded(r.withColumn("p_adj", benjamini_hochberg("p", "pair", "feature")).drop("p"), "p_adj")


@query(f"WITH {CELLS} SELECT '1' AS pair, CASE WHEN territory = 'BUILDING' THEN 'seed' ELSE 'query' END AS side, 'BUILDING' AS seed, 'MACHINERY FURNITURE' AS query, barcode FROM cells WHERE territory IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def deg_groups_pair(spark, sf):
    return markers.groups(retail_cells(spark, sf), ["BUILDING"], ["MACHINERY", "FURNITURE"])


@query(f"WITH {CELLS} SELECT barcode, x, y, CASE WHEN territory IN ('BUILDING', 'MACHINERY') THEN territory ELSE 'other' END AS territory, cell_type FROM cells")
def dispatch_territory(spark, sf):
    from ..operators.territory import dispatch

    return dispatch(retail_cells(spark, sf), ["BUILDING"], ["MACHINERY"])


@query(f"WITH {CELLS}, r AS (SELECT territory, CAST(row_number() OVER (ORDER BY territory) AS INTEGER) AS color FROM (SELECT DISTINCT territory FROM cells)) SELECT barcode, x, y, territory, color, round(CASE WHEN territory = 'BUILDING' THEN 0.65 ELSE 0.0975 END, 6) AS alpha FROM cells JOIN r USING (territory)")
def territory_plot(spark, sf):
    return rounded(views.territory_plot(retail_cells(spark, sf), ["BUILDING"]), "alpha")


@query(f"""WITH {_BEST}, n AS (SELECT bm.*, row_number() OVER (PARTITION BY "from" ORDER BY cost, "to") - 1 AS n FROM bm)
SELECT CAST("from" AS VARCHAR) || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS barcode, x, y, "from", "to" FROM n JOIN sd ON sd.barcode = "to" """)
def align_index(spark, sf):
    return mapping.align(_best(spark, sf).drop("feature", "niche"), _sides(spark, sf)[0])


@query(f"WITH {COUNTS}, t AS (SELECT feature, sum(value) AS total FROM counts GROUP BY 1) SELECT feature FROM t WHERE total > (SELECT quantile_cont(total, 0.25) FROM t)")
def top_features(spark, sf):
    from ..operators.normalize import top_features as top

    return top(retail_counts(spark, sf), 0.25)


@query(f"WITH {COUNTS}, g AS (SELECT feature, barcode, value, count(*) FILTER (value > 0) OVER (PARTITION BY feature) AS nnz FROM counts) SELECT feature, any_value(nnz) AS nnz, round(sum(value) / (SELECT count(*) FROM customer), 6) AS mean FROM g GROUP BY feature")
def feature_means(spark, sf):
    from ..operators.normalize import moments

    return rounded(moments(retail_counts(spark, sf), retail_cells(spark, sf).count()).select("feature", "nnz", "mean"), "mean")
