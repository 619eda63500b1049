"""Queries on images and territories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import image, spatial, territory, views
from ..sources.bindings import CELLS, _read, retail_cells
from .registry import query, rounded

TILES = "tiles AS (SELECT CAST(c_custkey AS VARCHAR) AS barcode, CAST(c_custkey % 40 AS INTEGER) + 1 AS x, CAST(floor(c_custkey / 40) AS INTEGER) + 1 AS y, 1 AS origin, c_mktsegment AS territory FROM customer)"
VALUES = "vals AS (SELECT CAST(c_custkey AS VARCHAR) AS barcode, 1 AS dim, c_acctbal AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, CAST(c_nationkey AS DOUBLE) FROM customer)"
PIXELS = f"""{TILES}, {VALUES}, mid AS (SELECT dim, quantile_cont(value, 0.5) AS mid FROM tiles JOIN vals USING (barcode) GROUP BY 1),
grid AS (SELECT dim, mid, CAST(gx AS INTEGER) AS x, CAST(gy AS INTEGER) AS y FROM mid, range(1, (SELECT max(x) + 1 FROM tiles)) a(gx), range(1, (SELECT max(y) + 1 FROM tiles)) b(gy)),
pixels AS (SELECT dim, g.x, g.y, coalesce(v.value, mid) AS value FROM grid g LEFT JOIN (SELECT dim, x, y, value FROM tiles JOIN vals USING (barcode)) v USING (dim, x, y))"""


def _tiles(spark, sf):
    return retail_cells(spark, sf).select("barcode", (F.col("x") + 1).cast("int").alias("x"), (F.col("y") + 1).cast("int").alias("y"), F.lit(1).alias("origin"))


def _values(spark, sf):
    c = _read(spark, sf, "customer")
    b = F.col("c_custkey").cast("string").alias("barcode")
    return c.select(b, F.lit(1).alias("dim"), F.col("c_acctbal").alias("value")).union(c.select(b, F.lit(2), F.col("c_nationkey").cast("double")))


def _pixels(spark, sf):
    return image.to_pixels(_values(spark, sf), _tiles(spark, sf))


@query(f"WITH {PIXELS} SELECT dim, x, y, round(value, 6) AS value FROM pixels")
def pixel_background(spark, sf):
    return rounded(_pixels(spark, sf), "value")


@query(f"WITH {PIXELS} SELECT t.barcode, dim, round(value, 6) AS value FROM tiles t JOIN pixels USING (x, y) WHERE origin = 1")
def origin_sample(spark, sf):
    return rounded(image.from_pixels(_pixels(spark, sf), _tiles(spark, sf)), "value")


@query(f"WITH {PIXELS} SELECT dim, x, y, round(cume_dist() OVER (PARTITION BY dim ORDER BY value), 6) AS value FROM pixels")
def ecdf_equalize(spark, sf):
    return rounded(image.ecdf(_pixels(spark, sf)), "value")


@query(f"""WITH {PIXELS}, q AS (SELECT dim, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pixels GROUP BY 1)
SELECT dim, x, y, round((least(greatest(value, lo), hi) - lo) / (hi - lo), 6) AS value FROM pixels JOIN q USING (dim)""")
def balance_simplest(spark, sf):
    return rounded(image.balance_simplest(_pixels(spark, sf)), "value")


@query(f"""WITH {PIXELS}, r AS (SELECT dim, x, y, avg(value) OVER (PARTITION BY dim, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS value FROM pixels)
SELECT dim, x, y, round(avg(value) OVER (PARTITION BY dim, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value FROM r""")
def box_smooth(spark, sf):
    return rounded(image.box_blur(_pixels(spark, sf), 2), "value")


@query(f"""WITH {PIXELS}, g AS (SELECT dim, x, y,
 (coalesce(lead(value) OVER (PARTITION BY dim, y ORDER BY x), value) - coalesce(lag(value) OVER (PARTITION BY dim, y ORDER BY x), value)) / 2 AS gx,
 (coalesce(lead(value) OVER (PARTITION BY dim, x ORDER BY y), value) - coalesce(lag(value) OVER (PARTITION BY dim, x ORDER BY y), value)) / 2 AS gy FROM pixels)
SELECT x, y, round(sqrt(sum(gx * gx + gy * gy)), 5) AS value FROM g GROUP BY x, y""")
def detect_edges(spark, sf):
    return rounded(image.edges(_pixels(spark, sf)), "value", digits=5)


@query(f"""WITH {PIXELS}, q AS (SELECT dim, quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM pixels GROUP BY 1),
i AS (SELECT dim, x, y, value, q, least(3, greatest(0, len(list_filter(q, lambda b: b <= value)) - 1)) AS i FROM pixels JOIN q USING (dim))
SELECT dim, x, y, round((i + CASE WHEN q[i + 2] > q[i + 1] THEN (value - q[i + 1]) / (q[i + 2] - q[i + 1]) ELSE 0 END) / 4, 6) AS value FROM i""")
def equalize_piecewise(spark, sf):
    return rounded(image.equalize_piecewise(_pixels(spark, sf), 3), "value")


def _plateau(down: str, up: str) -> str:
    """Histogram counts of 256 bins held between two plateaus, and their running share."""
    return f"""WITH {PIXELS}, rg AS (SELECT dim, min(value) AS lo, max(value) AS hi, count(*) AS size FROM pixels GROUP BY 1),
b AS (SELECT dim, x, y, least(255, floor((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 256)) AS b FROM pixels JOIN rg USING (dim)),
mean AS (SELECT max(size) / 256 AS mean FROM rg), h AS (SELECT dim, b, greatest({down}, least({up}, count(*))) AS n FROM b, mean GROUP BY dim, b, mean),
v AS (SELECT dim, b, sum(n) OVER (PARTITION BY dim ORDER BY b) / sum(n) OVER (PARTITION BY dim) AS v FROM h)
SELECT dim, x, y, round(v, 6) AS value FROM b JOIN v USING (dim, b)"""


@query(_plateau("10", "100"))
def equalize_plateau(spark, sf):
    return rounded(image.equalize_plateau(_pixels(spark, sf)), "value")


@query(_plateau("0.1 * mean", "10 * mean"))
def equalize_adaptive(spark, sf):
    return rounded(image.equalize(_pixels(spark, sf), "EqualizeADP"), "value")


_BOX = "box AS (SELECT max(x) AS mx, max(y) AS my FROM pixels)"


def _gauss(src: str, dst: str) -> str:
    """Rows, then columns, by Gaussian weights of sigma 1 and 2, border pixels repeated; the mean of both."""
    return f"""{dst}r AS (SELECT s, p.dim, p.x, p.y, sum(w * v.value) AS value FROM {src} p CROSS JOIN wts CROSS JOIN box JOIN {src} v ON v.dim = p.dim AND v.y = p.y AND v.x = least(greatest(p.x + o, 1), mx) GROUP BY s, p.dim, p.x, p.y),
{dst}c AS (SELECT s, p.dim, p.x, p.y, sum(w * v.value) AS value FROM {src} p CROSS JOIN wts CROSS JOIN box JOIN {dst}r v USING (s) WHERE v.dim = p.dim AND v.x = p.x AND v.y = least(greatest(p.y + o, 1), my) GROUP BY s, p.dim, p.x, p.y),
{dst} AS (SELECT dim, x, y, avg(value) AS value FROM {dst}c GROUP BY dim, x, y)"""


@query(f"""WITH {PIXELS}, {_BOX}, k AS (SELECT s, o, exp(-o * o / (2.0 * s * s)) AS k FROM range(1, 3) a(s), range(-6, 7) b(o) WHERE abs(o) <= 3 * s), wts AS (SELECT s, o, k / sum(k) OVER (PARTITION BY s) AS w FROM k),
{_gauss("pixels", "once")}, {_gauss("once", "twice")} SELECT dim, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(value, 6) AS value FROM twice""")
def smooth_iso(spark, sf):
    return rounded(image.smooth(_pixels(spark, sf), "iso", 2, [1, 2], across="mean"), "value")


@query(f"""WITH {PIXELS}, {_BOX} SELECT p.dim, CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y, round(median(v.value), 6) AS value FROM pixels p CROSS JOIN range(-2, 3) a(dx) CROSS JOIN range(-2, 3) b(dy) CROSS JOIN box
JOIN pixels v ON v.dim = p.dim AND v.x = least(greatest(p.x + dx, 1), mx) AND v.y = least(greatest(p.y + dy, 1), my) GROUP BY p.dim, p.x, p.y""")
def smooth_median(spark, sf):
    return rounded(image.smooth(_pixels(spark, sf), "median", box=5), "value")


@query()
def tv_regularise(spark, sf):
    return rounded(image.regularise(_pixels(spark, sf), 1, 30), "value")


@query()
def screened_poisson(spark, sf):
    return rounded(image.screened_poisson(_pixels(spark, sf)), "value")


@query(f"WITH {VALUES} SELECT barcode, dim, round((value - min(value) OVER (PARTITION BY dim)) / (max(value) OVER (PARTITION BY dim) - min(value) OVER (PARTITION BY dim)), 6) AS value FROM vals")
def color_rebalance(spark, sf):
    return rounded(views.rebalance_colors(_values(spark, sf)), "value")


@query(f"""WITH {TILES}, {VALUES} SELECT x, y, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS r, r AS g, r AS b FROM tiles JOIN vals USING (barcode) WHERE dim = 1""")
def image_plot(spark, sf):
    return rounded(views.image_plot(_values(spark, sf), _tiles(spark, sf), [1]), "r", "g", "b")


_RADIUS = "0.04 * sqrt(power((SELECT max(x) - min(x) FROM cells), 2) + power((SELECT max(y) - min(y) FROM cells), 2))"


@query(f"""WITH RECURSIVE {CELLS}, e AS (SELECT a.barcode AS a, b.barcode AS b FROM cells a JOIN cells b ON a.territory = b.territory AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {_RADIUS}),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS barcode, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1),
t AS (SELECT component, CAST(row_number() OVER (ORDER BY component) AS VARCHAR) AS t FROM s WHERE n > 10)
SELECT barcode, x, y, cells.territory AS segment, coalesce(t, 'isolated') AS territory FROM cells JOIN c USING (barcode) LEFT JOIN t USING (component)""")
def isolate_components(spark, sf):
    return territory.isolate(retail_cells(spark, sf).select("barcode", "x", "y", F.col("territory").alias("segment")), 0.04, 10)


@query(f"""WITH {CELLS}, k AS (SELECT CAST(barcode AS BIGINT) AS barcode, territory AS segment, CASE WHEN cell_type = 0 THEN 'isolated' ELSE CAST(cell_type % 3 AS VARCHAR) END AS trial FROM cells),
f AS (SELECT segment, trial, min(barcode) AS f FROM k WHERE trial <> 'isolated' GROUP BY ALL), n AS (SELECT segment, trial, CAST(dense_rank() OVER (ORDER BY f, segment, trial) AS VARCHAR) AS n FROM f)
SELECT barcode, segment, coalesce(n, 'isolated') AS trial FROM k LEFT JOIN n USING (segment, trial)""")
def globalise(spark, sf):
    c = retail_cells(spark, sf)
    return territory.globalise(c.select(F.col("barcode").cast("long").alias("barcode"), F.col("territory").alias("segment"), F.when(F.col("cell_type") == 0, "isolated").otherwise((F.col("cell_type") % 3).cast("string")).alias("trial")))


def _mask(spark, sf):
    return _tiles(spark, sf).join(retail_cells(spark, sf).where("territory = 'BUILDING'").select("barcode"), "barcode", "left_semi").select("x", "y")


@query(f"WITH {TILES} SELECT DISTINCT CAST(x + dx AS INTEGER) AS x, CAST(y + dy AS INTEGER) AS y FROM tiles, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE territory = 'BUILDING'")
def dilate(spark, sf):
    return territory.dilate(_mask(spark, sf), 3)


@query(f"""WITH {TILES}, m AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM tiles, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE territory = 'BUILDING')
SELECT CAST(x - dx AS INTEGER) AS x, CAST(y - dy AS INTEGER) AS y FROM m, range(-1, 2) a(dx), range(-1, 2) b(dy) GROUP BY ALL HAVING count(*) = 9""")
def erode(spark, sf):
    """The closing of a territory: grown by three pixels, then shrunk by three."""
    return territory.erode(territory.dilate(_mask(spark, sf), 3), 3)


@query(f"""WITH {TILES}, m AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM tiles, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE territory = 'BUILDING')
SELECT barcode, CASE WHEN m.x IS NOT NULL THEN 'BUILDING' ELSE territory END AS territory FROM tiles LEFT JOIN m USING (x, y)""")
def territory_morphing(spark, sf):
    return territory.morph(retail_cells(spark, sf).select("barcode", "territory"), _tiles(spark, sf), ["BUILDING"], [3])


@query(f"""WITH {TILES}, m AS (SELECT * FROM tiles WHERE territory IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')),
g AS (SELECT x, y FROM range(0, (SELECT max(x) + 2 FROM tiles)) a(x), range(0, (SELECT max(y) + 2 FROM tiles)) b(y)),
out AS (SELECT g.x, g.y FROM g LEFT JOIN m USING (x, y) WHERE m.barcode IS NULL),
d AS (SELECT m.barcode, min(greatest(abs(m.x - o.x), abs(m.y - o.y))) AS d FROM m, out o GROUP BY 1)
SELECT barcode, coalesce(CAST(d AS VARCHAR), 'out') AS layer FROM tiles LEFT JOIN d USING (barcode)""")
def layer_peel(spark, sf):
    return territory.layers(retail_cells(spark, sf).select("barcode", "territory"), _tiles(spark, sf), ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"])


@query(f"WITH {CELLS} SELECT territory AS label, CAST(row_number() OVER (ORDER BY territory) AS INTEGER) AS rank FROM (SELECT DISTINCT territory FROM cells)")
def order_labels(spark, sf):
    return views.order_labels(retail_cells(spark, sf).select(F.col("territory").alias("label")))


@query()
def territory_hulls(spark, sf):
    return views.territory_plot(retail_cells(spark, sf), contour="convex")


@query(f"""WITH RECURSIVE {TILES}, s(d, nx, ny, ax, ay, qx, qy) AS (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)),
e AS (SELECT t.territory, d, t.x + ax AS ax, t.y + ay AS ay, t.x + qx AS qx, t.y + qy AS qy FROM tiles t, s WHERE NOT EXISTS (SELECT 1 FROM tiles o WHERE o.territory = t.territory AND o.x = t.x + nx AND o.y = t.y + ny)),
k AS (SELECT e.territory, e.ax, e.ay, e.d, o.ax AS nax, o.ay AS nay, o.d AS nd, row_number() OVER (PARTITION BY e.territory, e.ax, e.ay, e.d ORDER BY CASE (o.d - e.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS r FROM e JOIN e o ON o.territory = e.territory AND o.ax = e.qx AND o.ay = e.qy),
n AS (SELECT territory, ax, ay, d, nax, nay, nd FROM k WHERE r = 1),
w(territory, sx, sy, sd, x, y, d, step) AS (SELECT territory, ax, ay, d, ax, ay, d, 0 FROM n
 UNION ALL SELECT w.territory, sx, sy, sd, nax, nay, nd, step + 1 FROM w JOIN n ON n.territory = w.territory AND n.ax = w.x AND n.ay = w.y AND n.d = w.d WHERE NOT (nax = sx AND nay = sy AND nd = sd)),
l AS (SELECT territory, sx, sy, sd, min((x, y, d)) = (sx, sy, sd) AS lead FROM w GROUP BY 1, 2, 3, 4)
SELECT territory, concat(sx, ',', sy, ',', sd) AS ring, CAST(step AS BIGINT) AS step, x, y FROM w JOIN l USING (territory, sx, sy, sd) WHERE lead""")
def territory_borders(spark, sf):
    """Border rings of the market segments on the customers' raster."""
    t = _tiles(spark, sf).join(retail_cells(spark, sf).select("barcode", "territory"), "barcode")
    return territory.borders(t)


_SPREAD = 3.0


@query(f"WITH {CELLS} SELECT barcode, true AS covered, false AS clash FROM cells")
def bubble_centers(spark, sf):
    """Whether each cell has a centre within the radius, and whether it is a centre with another one there."""
    cells = retail_cells(spark, sf).select("barcode", "x", "y")
    centers = spatial.spread(cells, _SPREAD)
    own = centers.select(F.col("barcode").alias("c"), F.lit(True).alias("is"))
    near = spatial.radius_join(cells, centers, _SPREAD).groupBy(F.col("center").alias("c")).agg(F.count("*").alias("n"))
    each = cells.select(F.col("barcode").alias("c")).join(near, "c", "left").join(own, "c", "left")
    return each.select(F.col("c").alias("barcode"), F.col("n").isNotNull().alias("covered"), (F.coalesce("is", F.lit(False)) & (F.coalesce("n", F.lit(0)) > 1)).alias("clash"))
