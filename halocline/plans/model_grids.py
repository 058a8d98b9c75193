"""Queries of model columns, curvilinear grids and rasters, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.steps import scratch_folder
from ..operators import curvilinear, layers, tiles, variances
from ..schema import EARTH_RADIUS, PI
from ..sources import decoders, gridded, records
from . import tables as t
from .registry import query, r

# ---- layers: a column for each part, a layer for each supplier group; every seventh has no thickness

_DEPTHS = [0.0, 3.0, 7.5, 12.0, 20.0, 33.0, 60.0]
_INTERFACES = [0.0, 2.0, 5.0, 5.0, 10.0, 20.5, 40.0, 80.0]


def _columns(spark, d) -> DataFrame:
    k = F.col("l_suppkey") % 10
    rows = t.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), k.alias("k")).agg((F.avg("l_quantity") * 1.03717283).alias("a"), F.avg(F.round(F.col("l_discount") * 100)).alias("h"))
    thickness = F.when((F.col("part") + F.col("k")) % 7 == 0, 0.0).otherwise(F.col("h") + 1)
    return layers.stacked(rows, ["part"], "k", thickness, F.col("a"))


def _reconstructed(spark, d, method: str) -> DataFrame:
    """part, what (at: a depth, over: an interval), n (from 1) and value."""
    x = _columns(spark, d).select("part", layers.sampled("interfaces", "values", _DEPTHS, method).alias("at"), layers.averaged("interfaces", "values", _INTERFACES, method).alias("over"))
    x = x.select("part", F.explode(F.map_from_arrays(F.array(F.lit("at"), F.lit("over")), F.array("at", "over"))).alias("what", "v"))
    return x.select("part", "what", F.posexplode("v").alias("n", "value")).select("part", "what", (F.col("n") + 1).alias("n"), r("value").alias("value"))


_LAYERS = f"""lay AS (SELECT l_partkey AS part, l_suppkey % 10 AS k, avg(l_quantity) * 1.03717283::DOUBLE AS a, CASE WHEN (l_partkey + l_suppkey % 10) % 7 = 0 THEN 0.0::DOUBLE ELSE avg(round(l_discount * 100)) + 1 END AS h FROM lineitem GROUP BY 1, 2),
num AS (SELECT part, a, h, greatest(h, {layers.THIN}::DOUBLE) AS d, row_number() OVER w AS j, count(*) OVER (PARTITION BY part) AS n, coalesce(sum(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM lay WINDOW w AS (PARTITION BY part ORDER BY k)),
nei AS (SELECT *, lag(a) OVER w AS a0, lead(a) OVER w AS a2, lag(d) OVER w AS d0, lead(d) OVER w AS d2, lag(d, 2) OVER w AS dd0, lead(d, 2) OVER w AS dd2 FROM num WINDOW w AS (PARTITION BY part ORDER BY j))"""

_OUT = f"""bot AS (SELECT part, max(top + h) AS bottom FROM num GROUP BY part),
z AS (SELECT z, row_number() OVER () AS n FROM (SELECT unnest({_DEPTHS}::DOUBLE[]) AS z)),
pick AS (SELECT c.part, z.n, z.z, min(c.j) AS j FROM c, z WHERE c.top + c.h >= z.z GROUP BY ALL),
at_ AS (SELECT b.part, z.n, c.c0 + (z.z - c.top) / c.d * (c.c1 + c.c2 * (1 - (z.z - c.top) / c.d)) AS value FROM bot b CROSS JOIN z LEFT JOIN pick p ON p.part = b.part AND p.n = z.n LEFT JOIN c ON c.part = p.part AND c.j = p.j),
iv AS (SELECT n, lo, hi FROM (SELECT row_number() OVER () AS n, x AS lo, lead(x) OVER () AS hi FROM (SELECT unnest({_INTERFACES}::DOUBLE[]) AS x)) WHERE hi IS NOT NULL),
cut AS (SELECT b.part, n, least(lo, bottom) AS lo, least(hi, bottom) AS hi, lo >= bottom AS below FROM bot b, iv),
q AS (SELECT cut.*, h, c0, c1, c2, least(greatest((cut.lo - top) / d, 0), 1) AS p, least(greatest((cut.hi - top) / d, 0), 1) AS q FROM cut JOIN c ON cut.part = c.part),
m AS (SELECT part, n, any_value(below) AS below, any_value(hi - lo) AS t, sum(h * (q * (c0 + q * ((c1 + c2) / 2 - q * c2 / 3)) - p * (c0 + p * ((c1 + c2) / 2 - p * c2 / 3)))) AS s FROM q GROUP BY part, n),
o AS (SELECT part, n, below, t, CASE WHEN t >= {layers.THIN} THEN s / t END AS v FROM m),
over_ AS (SELECT part, n, CASE WHEN below THEN NULL WHEN t < {layers.THIN} THEN lag(v) OVER (PARTITION BY part ORDER BY n) ELSE v END AS value FROM o)
SELECT part, 'at' AS what, n::INT AS n, round(value, 6) AS value FROM at_ UNION ALL SELECT part, 'over', n::INT, round(value, 6) FROM over_"""


@query(f"""WITH RECURSIVE {_LAYERS},
raw AS (SELECT *, 2 * d / (d0 + d) * (a - a0) AS u, 2 * d / (d + d2) * (a2 - a) AS l FROM nei),
s0 AS (SELECT *, CASE WHEN n >= 3 AND j > 1 AND j < n AND u * l > 0 THEN sign(u) * least(abs(u), abs(l)) ELSE 0.0::DOUBLE END AS s FROM raw),
s1 AS (SELECT *, lead(s) OVER (PARTITION BY part ORDER BY j) AS sn FROM s0),
f AS (SELECT part, j, 0.0::DOUBLE AS s FROM s1 WHERE j = 1 UNION ALL
      SELECT x.part, x.j, CASE WHEN x.s <> 0 THEN x.s + 2 * CASE WHEN x.a - x.a0 - (x.s + f.s) / 2 < 0 THEN -1 ELSE 1 END * least(abs(x.a - x.a0 - (x.s + f.s) / 2), abs(x.a2 - x.a - (x.sn + x.s) / 2)) ELSE 0.0::DOUBLE END FROM f JOIN s1 x ON x.part = f.part AND x.j = f.j + 1),
c AS (SELECT num.*, num.a - f.s / 2 AS c0, f.s AS c1, 0.0::DOUBLE AS c2 FROM num JOIN f ON num.part = f.part AND num.j = f.j), {_OUT}""")
def layers_by_linear_profiles(spark, d):
    return _reconstructed(spark, d, "linear")


@query(f"""WITH {_LAYERS},
mean AS (SELECT *, d / (d0 + d + d2) * ((2 * d0 + d) / (d + d2) * (a2 - a) + (d + 2 * d2) / (d0 + d) * (a - a0)) AS u FROM nei),
sl AS (SELECT *, CASE WHEN j > 1 AND j < n AND (a - a0) * (a2 - a) > 0 THEN sign(u) * least(abs(u), 2 * abs(a - a0), 2 * abs(a2 - a)) ELSE 0 END AS s FROM mean),
nx AS (SELECT *, lead(s) OVER (PARTITION BY part ORDER BY j) AS s2 FROM sl),
e AS (SELECT *, CASE WHEN j = 1 THEN a WHEN j = n - 1 THEN a2 ELSE a + d / (d + d2) * (a2 - a) + (2 * d2 * d / (d + d2) * ((d0 + d) / (2 * d + d2) - (dd2 + d2) / (2 * d2 + d)) * (a2 - a)
  - d * (d0 + d) / (2 * d + d2) * s2 + d2 * (dd2 + d2) / (2 * d2 + d) * s) / (d0 + d + d2 + dd2) END AS below FROM nx),
b AS (SELECT *, CASE WHEN j = 2 THEN a0 ELSE lag(below) OVER (PARTITION BY part ORDER BY j) END AS above FROM e),
p AS (SELECT *, below - above AS rise, 6 * a - 3 * (above + below) AS bend FROM b),
ed AS (SELECT part, j, CASE WHEN n < 3 OR j = 1 OR j = n OR (a - a0) * (a2 - a) <= 0 THEN a WHEN rise * bend > rise * rise THEN 3 * a - 2 * below ELSE above END AS t,
  CASE WHEN n < 3 OR j = 1 OR j = n OR (a - a0) * (a2 - a) <= 0 THEN a WHEN rise * bend < -(rise * rise) THEN 3 * a - 2 * above ELSE below END AS u FROM p),
c AS (SELECT num.*, t AS c0, u - t AS c1, 6 * a - 3 * (t + u) AS c2 FROM num JOIN ed ON num.part = ed.part AND num.j = ed.j), {_OUT}""")
def layers_by_parabolic_profiles(spark, d):
    return _reconstructed(spark, d, "parabolic")


# ---- curvilinear grids: 36 x 18 nodes on a sheared grid across the date line, so that indexes have a closed form

_SHEAR = (300.317, 6.13, -1.57, -50.211, 0.83, 4.07)


def _sheared(spark, d) -> DataFrame:
    x0, xi, xj, y0, yi, yj = _SHEAR
    n = F.col("o_orderkey") % 648
    nodes = t.read(spark, d, "orders").select((n % 36).cast("int").alias("i"), F.floor(n / 36).cast("int").alias("j")).distinct()
    i, j = F.col("i"), F.col("j")
    return nodes.select((i + 1).alias("i"), (j + 1).alias("j"), F.pmod(x0 + xi * i + xj * j, F.lit(360.0)).alias("lon"), (y0 + yi * i + yj * j).alias("lat"))


def _sheared_index(extra: str = "") -> str:
    """CTEs up to ``ix`` (obs_id, lon, lat, a, b: indexes from 0, null outside of the grid)."""
    x0, xi, xj, y0, yi, yj = _SHEAR
    det = f"({xi}::DOUBLE * {yj} - {xj}::DOUBLE * {yi})"
    return f"""{t.OBS}, dx AS (SELECT obs_id, lon, lat, lat - {y0}::DOUBLE AS v, lon - {x0}::DOUBLE + 360 * k AS u FROM obs, (VALUES (0), (1)) AS turns(k)),
ab AS (SELECT *, (u * {yj}::DOUBLE - v * {xj}::DOUBLE) / {det} AS a, (v * {xi}::DOUBLE - u * {yi}::DOUBLE) / {det} AS b FROM dx),
hit AS (SELECT * FROM ab WHERE a >= 0 AND a <= 35 AND b >= 0 AND b <= 17),
ix AS (SELECT o.obs_id, hit.lon, hit.lat, a, b FROM obs o LEFT JOIN hit ON o.obs_id = hit.obs_id)"""


@query(f"WITH {_sheared_index()} SELECT obs_id, round(a + 1, 6) AS ri, round(b + 1, 6) AS rj FROM ix")
def quadrilateral_indexes(spark, d):
    """Indexes of all observations by inverting the bilinear mapping of the cell that holds them."""
    o = t.observations(spark, d).select("obs_id", "lon", "lat")
    return curvilinear.quadrilateral_index(o, _sheared(spark, d), 36, 18, periodic=False, step=5.0).select("obs_id", r("ri").alias("ri"), r("rj").alias("rj"))


_PI180 = f"({PI}::DOUBLE / 180)"


@query(f"""WITH {_sheared_index()}, c AS (SELECT obs_id, lon, lat, floor(a) AS i, floor(b) AS j, p, q FROM ix, (VALUES (0), (1)) AS x(p), (VALUES (0), (1)) AS y(q) WHERE a IS NOT NULL),
g AS (SELECT *, {_SHEAR[0]}::DOUBLE + {_SHEAR[1]}::DOUBLE * (i + p) + {_SHEAR[2]}::DOUBLE * (j + q) AS glon, {_SHEAR[3]}::DOUBLE + {_SHEAR[4]}::DOUBLE * (i + p) + {_SHEAR[5]}::DOUBLE * (j + q) AS glat FROM c),
w AS (SELECT *, 1 / pow(acos(least(1, sin(lat * {_PI180}) * sin(glat * {_PI180}) + cos(lat * {_PI180}) * cos(glat * {_PI180}) * cos((glon - lon) * {_PI180}))), 2) AS w FROM g),
m AS (SELECT obs_id, 1 + sum(w * (i + p)) / sum(w) AS ri, 1 + sum(w * (j + q)) / sum(w) AS rj FROM w GROUP BY obs_id)
SELECT ix.obs_id, round(ri, 5) AS ri, round(rj, 5) AS rj FROM ix LEFT JOIN m ON ix.obs_id = m.obs_id""")
def quadrilateral_indexes_by_distance(spark, d):
    """Indexes of all observations as means over the corners of their cell by inverse squares of distances."""
    o = t.observations(spark, d).select("obs_id", "lon", "lat")
    out = curvilinear.quadrilateral_index(o, _sheared(spark, d), 36, 18, periodic=False, weights="distance", step=5.0)
    return out.select("obs_id", r("ri", 5).alias("ri"), r("rj", 5).alias("rj"))


@query(f"""WITH {t.OBS}, {t.FIELD}, node AS (SELECT i, j, ((lon * 1.7::DOUBLE + lat * 0.31::DOUBLE) % 360 + 360) % 360 AS lon, lat * 0.9::DOUBLE + i * 0.37::DOUBLE AS lat FROM field),
o AS (SELECT obs_id, lon, lat FROM (SELECT min(obs_id) AS obs_id, lon, lat FROM obs GROUP BY lon, lat)),
d AS (SELECT obs_id, i, j, acos(least(1, greatest(-1, sin(o.lat * {_PI180}) * sin(n.lat * {_PI180}) + cos(o.lat * {_PI180}) * cos(n.lat * {_PI180}) * cos((n.lon - o.lon) * {_PI180})))) * {EARTH_RADIUS}::DOUBLE AS dist FROM o, node n),
k AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY dist, (j - 1) * 36 + i) AS rank FROM d WHERE dist <= 2000000),
f AS (SELECT *, first_value(i) OVER (PARTITION BY obs_id ORDER BY rank) AS i0, count(*) OVER (PARTITION BY obs_id) AS n FROM k WHERE rank <= 4),
m AS (SELECT obs_id, max(i0) + sum((((i - i0 + 18) % 36 + 36) % 36 - 18) / dist / dist) / sum(1 / dist / dist) AS ri, sum(j / dist / dist) / sum(1 / dist / dist) AS rj FROM f WHERE n = 4 GROUP BY obs_id)
SELECT o.obs_id, round(ri, 4) AS ri, round(rj, 4) AS rj FROM o LEFT JOIN m ON o.obs_id = m.obs_id""")
def nearest_four_indexes(spark, d):
    """Indexes of all places of observations as means over the four nearest nodes of a twisted grid."""
    f = t.field(spark, d)
    grid = f.select("i", "j", F.pmod(F.col("lon") * 1.7 + F.col("lat") * 0.31, F.lit(360.0)).alias("lon"), (F.col("lat") * 0.9 + F.col("i") * 0.37).alias("lat"))
    o = t.observations(spark, d).groupBy("lon", "lat").agg(F.min("obs_id").alias("obs_id"))
    return curvilinear.nearest_four_index(o, grid, 36).select("obs_id", r("ri", 4).alias("ri"), r("rj", 4).alias("rj"))


@query(f"""WITH {t.FIELD}, {t.STATIONS}, top AS (SELECT avg(value) AS value FROM field WHERE j = 18),
node AS (SELECT ij AS cell, (lon * 1.30713::DOUBLE + lat * 0.21377::DOUBLE + 720) % 360 AS lon, lat * 1.05139::DOUBLE AS lat FROM field),
o AS (SELECT cell, (lon - 5 + 360) % 360 / 10 + 1 AS ri, (lat + 85) / 10 + 1 AS rj FROM node),
q AS (SELECT cell, (floor(ri)::INT + a + 35) % 36 + 1 AS i, floor(rj)::INT + b AS j, (CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END) AS w
  FROM o, (VALUES (0), (1)) AS v1(a), (VALUES (0), (1)) AS v2(b) WHERE rj >= 1),
m AS (SELECT cell, CASE WHEN count(value) = count(*) THEN sum(w * value) END AS hx FROM q LEFT JOIN field f ON q.i = f.i AND q.j = f.j WHERE w > 0 GROUP BY cell)
SELECT o.cell, round(CASE WHEN rj > 18 THEN (SELECT value FROM top) ELSE hx END, 6) AS hx FROM o LEFT JOIN m ON o.cell = m.cell""")
def regridded_to_curvilinear(spark, d):
    """A field of a regular grid at the nodes of a curvilinear one that goes beyond its first and last rows."""
    f = t.field(spark, d)
    nodes = f.select(F.col("ij").alias("cell"), F.pmod(F.col("lon") * 1.30713 + F.col("lat") * 0.21377, F.lit(360.0)).alias("lon"), (F.col("lat") * 1.05139).alias("lat"))
    return curvilinear.to_curvilinear(f, nodes, 5.0, 10.0, 36, -85.0, 10.0, 18).select("cell", r("hx").alias("hx"))


# ---- rasters in tiles of ten cells, so that several meet


@query(f"""WITH RECURSIVE {t.FIELD}, c AS (SELECT g.n, g.n % 36 + 1 AS i, g.n // 36 + 1 AS j, CASE WHEN f.kmt > 0 THEN f.value END AS v FROM range(648) g(n) LEFT JOIN field f ON f.ij = g.n + 1),
start AS (SELECT list(v ORDER BY n) AS v0 FROM c),
near AS (SELECT list([n + 1, j * 36 - 36 + i % 36 + 1, CASE WHEN j < 18 THEN n + 1 + 36 ELSE 17 * 36 + 37 - i END, j * 36 - 36 + (i + 34) % 36 + 1, CASE WHEN j > 1 THEN n + 1 - 36 END] ORDER BY n) AS q FROM c),
s AS (SELECT 0 AS step, v0 AS v, 1::BIGINT AS moved FROM start UNION ALL
  SELECT step + 1, list_transform(w, lambda x: x.new), len(list_filter(w, lambda x: x.moved)) FROM (
    SELECT step, list_transform(m, lambda x: {{'new': CASE WHEN x.gap AND x.n > 0 THEN (x.t + x.n * coalesce(x.own, 0)) / (x.n * CASE WHEN x.own IS NULL THEN 1 ELSE 2 END) ELSE x.own END,
      'moved': x.gap AND x.n > 0 AND (x.own IS NULL OR abs(x.own - (x.t + x.n * x.own) / (x.n * 2)) > 0.0001 * abs(x.own))}}) AS w FROM (
      SELECT step, list_transform(q, lambda k, pos: {{'own': v[k[1]], 'gap': v0[k[1]] IS NULL AND pos > 36,
        't': coalesce(v[k[2]], 0) + coalesce(v[k[3]], 0) + coalesce(v[k[4]], 0) + coalesce(v[k[5]], 0),
        'n': CASE WHEN v[k[2]] IS NULL THEN 0 ELSE 1 END + CASE WHEN v[k[3]] IS NULL THEN 0 ELSE 1 END + CASE WHEN v[k[4]] IS NULL THEN 0 ELSE 1 END + CASE WHEN k[5] IS NULL OR v[k[5]] IS NULL THEN 0 ELSE 1 END}}) AS m
      FROM s, start, near WHERE s.moved > 0))),
l AS (SELECT v FROM s ORDER BY step DESC LIMIT 1), u AS (SELECT unnest(v) AS v, generate_subscripts(v, 1) - 1 AS n FROM l)
SELECT (n % 36 + 1)::INT AS i, (n // 36 + 1)::INT AS j, round(v, 5) AS value FROM u""")
def filled_rasters(spark, d):
    """A field whose land cells take what relaxes to the mean of their neighbours."""
    x = t.field(spark, d).select(F.lit(1).alias("raster"), "i", "j", F.when(F.col("kmt") > 0, F.col("value")).alias("value"))
    return tiles.relaxed_fill(x, "raster", 36, 18, side=10).select("i", "j", r("value", 5).alias("value"))


_WET = f"""{t.FIELD}, wet AS (SELECT k AS raster, i, j, value / 7919::DOUBLE + k * 0.37::DOUBLE AS value FROM field, (VALUES (1), (2), (3)) AS v(k) WHERE kmt >= k)"""


def _wet(spark, d) -> DataFrame:
    x = t.field(spark, d).withColumn("raster", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where(F.col("kmt") >= F.col("raster"))
    return x.select("raster", "i", "j", (F.col("value") / 7919 + F.col("raster") * 0.37).alias("value"))


@query(f"""WITH {_WET} SELECT a.raster, a.i, a.j, round(avg(b.value), 7) AS value FROM wet a JOIN wet b ON a.raster = b.raster AND abs(a.j - b.j) <= 2 AND least(abs(a.i - b.i), 36 - abs(a.i - b.i)) <= 3 GROUP BY 1, 2, 3""")
def smoothed_variances(spark, d):
    """Means over seven columns and five rows of wet cells, at three levels."""
    return tiles.box_mean(_wet(spark, d), "raster", 36, 18, 3, 2, side=10).where("value is not null").select("raster", "i", "j", r("value", 7).alias("value"))


@query(f"""WITH {_WET}, b AS (SELECT raster, least(floor(value * 100), 99)::INT AS b, count(*) AS n FROM wet WHERE floor(value * 100) >= 1 GROUP BY 1, 2),
m AS (SELECT raster, b, row_number() OVER (PARTITION BY raster ORDER BY n DESC, b) AS o FROM b),
e AS (SELECT x.raster, least(coalesce(b, 1) / 100.0::DOUBLE, 1.2 - 0.0 * x.raster) AS least FROM (SELECT DISTINCT raster FROM wet) x LEFT JOIN m ON m.raster = x.raster AND o = 1),
w AS (SELECT wet.*, e.least FROM wet JOIN e USING (raster)),
d AS (SELECT a.raster, a.i, a.j, greatest(abs(a.j - b.j), least(abs(a.i - b.i), 36 - abs(a.i - b.i))) AS d, b.value FROM w a JOIN w b ON a.raster = b.raster WHERE a.value < a.least AND b.value >= b.least),
n AS (SELECT raster, i, j, min(d) AS d FROM d WHERE d <= 17 GROUP BY 1, 2, 3),
f AS (SELECT d.raster, d.i, d.j, avg(value) AS value FROM d JOIN n ON d.raster = n.raster AND d.i = n.i AND d.j = n.j AND d.d = n.d GROUP BY 1, 2, 3)
SELECT w.raster, w.i, w.j, round(coalesce(f.value, w.value), 6) AS value FROM w LEFT JOIN f ON w.raster = f.raster AND w.i = f.i AND w.j = f.j""")
def filled_low_variances(spark, d):
    """Values below the bound that most lie in, from the smallest squares around them."""
    x = _wet(spark, d)
    return tiles.fill_from_squares(x, "raster", 36, 18, tiles.fill_bounds(x, "raster", 1.2), side=10).where("value is not null").select("raster", "i", "j", r("value").alias("value"))


_Z = [5.0, 15.0, 25.5, 40.0, 62.0, 90.0, 130.0, 180.0, 250.0, 340.0]


@query(f"""WITH lay AS (SELECT l_partkey % 500 AS cell, row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY l_suppkey % 10) - 1 AS k, 30 - (l_suppkey % 10) * 1.7::DOUBLE - avg(l_quantity) * 0.0713::DOUBLE AS v FROM lineitem GROUP BY l_partkey % 500, l_suppkey % 10),
c AS (SELECT cell, list(v ORDER BY k) AS v, len(list(v)) AS n FROM lay GROUP BY cell),
z AS (SELECT {_Z}::DOUBLE[] AS z), mid AS (SELECT z, list_transform(range(10), lambda k: CASE WHEN k = 0 THEN 0 ELSE (z[k] + z[k + 1]) / 2 END) AS m FROM z),
ax AS (SELECT z, list_transform(range(10), lambda k: CASE WHEN k BETWEEN 1 AND 8 THEN (m[k + 2] - z[k + 1]) / (m[k + 2] - m[k + 1]) ELSE 0.5 END) AS w FROM mid),
g AS (SELECT cell, n, list_transform(range(n), lambda k: CASE WHEN n = 1 THEN 0.0::DOUBLE WHEN n = 2 THEN (v[1] - v[2]) / (z[2] - z[1]) ELSE
  (v[greatest(1, least(k, n - 2))] - v[greatest(1, least(k, n - 2)) + 1]) / (z[greatest(1, least(k, n - 2)) + 1] - z[greatest(1, least(k, n - 2))]) * w[greatest(1, least(k, n - 2)) + 1]
  + (v[greatest(1, least(k, n - 2)) + 1] - v[greatest(1, least(k, n - 2)) + 2]) / (z[greatest(1, least(k, n - 2)) + 2] - z[greatest(1, least(k, n - 2)) + 1]) * (1 - w[greatest(1, least(k, n - 2)) + 1]) END) AS g FROM c, ax),
t AS (SELECT max(list_max(g)) AS top FROM g), h AS (SELECT cell, n, list_transform(g, lambda x: greatest(x, 0) / top) AS h FROM g, t),
f AS (SELECT cell, CASE WHEN n > 1 THEN [h[2]] || h[2:] ELSE h END AS f FROM h),
q AS (SELECT cell, list_transform(f, lambda x: sqrt(x)) AS q FROM f),
p AS (SELECT cell, q, CASE WHEN list_max(q) > 0 THEN list_position(q, list_max(q)) ELSE 1 END AS p FROM q),
e AS (SELECT cell, list_transform(q, lambda x, k: CASE WHEN k >= p AND p < 10 THEN x * (z[10] - z[k] + 0.3::DOUBLE * (z[k] - z[p])) / (z[10] - z[p]) ELSE x END) AS e FROM p, z),
s AS (SELECT cell, CASE WHEN e[1] < 0.2 THEN list_transform(e, lambda x, k: CASE WHEN k < coalesce(list_position(list_transform(e, lambda y: y >= 0.2), true), 0) THEN 0.2::DOUBLE ELSE x END)
  WHEN e[1] > 0.8 THEN list_transform(e, lambda x, k: CASE WHEN k < coalesce(list_position(list_transform(e, lambda y: y <= 0.8), true), 0) THEN 0.8::DOUBLE ELSE x END) ELSE e END AS s FROM e),
m AS (SELECT cell, list_transform(s, lambda x, k: list_avg(s[greatest(k - 1, 1):k + 1])) AS m FROM s)
SELECT cell, (generate_subscripts(m, 1))::INT AS k, round(unnest(m), 7) AS value FROM m""")
def variances_of_columns(spark, d):
    """Vertical gradients, scaled by the largest, their roots, tapered, with bounds at the surface, and means of three levels."""
    k = F.col("l_suppkey") % 10
    rows = t.read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("cell"), k.alias("k")).agg(F.avg("l_quantity").alias("q"))
    rows = rows.select("cell", "k", (30 - F.col("k") * 1.7 - F.col("q") * 0.0713).alias("v"))
    x = rows.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "v")))["v"].alias("v"))
    x = variances.normalised(x.select(F.lit(1).alias("one"), "cell", variances.gradients(F.col("v"), _Z).alias("values")), ["one"])
    x = x.select("cell", variances.tapered(variances.roots(F.col("values")), _Z, 0.3).alias("v"))
    x = x.select("cell", variances.mean_of_levels(variances.surface_within(F.col("v"), 0.2, 0.8), 1).alias("v"))
    return x.select("cell", F.posexplode("v").alias("k", "value")).select("cell", (F.col("k") + 1).alias("k"), r("value", 7).alias("value"))


# ---- files: tables through sinks and back


@query("""WITH c AS (SELECT o_orderkey % 648 AS n, avg(o_totalprice)::FLOAT AS v, (count(*) * 1.5)::FLOAT AS w FROM orders GROUP BY 1),
r AS (SELECT 't' AS field, 1 AS k, n, v FROM c UNION ALL SELECT 't', 2, n, w FROM c UNION ALL SELECT 'ssh', 1, n, v FROM c)
SELECT field, k, (n % 36 + 1)::INT AS i, (n // 36 + 1)::INT AS j, CASE WHEN field = 't' THEN k * 10.0::DOUBLE END AS lev, (n % 36) * 10.0::DOUBLE + 5 AS lon, (n // 36) * 10.0::DOUBLE - 85 AS lat, v::DOUBLE AS value FROM r WHERE field = 'ssh' OR k = 1""")
def rasters_written_and_read(spark, d):
    """Cells written as a raster with its control file; of what was written only the first level is read."""
    n = F.col("o_orderkey") % 648
    c = t.read(spark, d, "orders").groupBy(n.alias("n")).agg(F.avg("o_totalprice").alias("v"), (F.count("*") * 1.5).alias("w"))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("k"), F.col(v).alias("value")) for f, k, v in (("t", 1, "v"), ("t", 2, "w"), ("ssh", 1, "v"))])
    cells = c.select((F.col("n") % 36 + 1).cast("int").alias("i"), (F.floor(F.col("n") / 36) + 1).cast("int").alias("j"), F.explode(parts).alias("p")).select("p.field", "p.k", "i", "j", "p.value")
    place = scratch_folder(spark)
    gridded.write_raster(cells, f"{place}.grd", 36, 18, [("t", 2), ("ssh", 1)])
    gridded.write_control(f"{place}.ctl", f"{place}.grd", (5.0, 10.0, 36), (-85.0, 10.0, 18), [10.0, 20.0], [("t", 2), ("ssh", 0)])
    return gridded.read_grids(spark, f"{place}.ctl", "described_raster", levels=[1]).select("field", "k", "i", "j", "lev", "lon", "lat", "value")


@query(f"WITH {t.OBS} SELECT elem AS id, qc, count(*) AS n, round(sum(dat::FLOAT::DOUBLE), 4) AS dat, round(sum((err * 0.1::DOUBLE)::FLOAT::DOUBLE), 4) AS err FROM (SELECT *, (obs_id % 3)::INT AS qc FROM obs) GROUP BY 1, 2")
def records_written_and_read(spark, d):
    """Observations written as record files by every task, and read again."""
    o = t.observations(spark, d)
    rows = o.select(F.col("elem").alias("id"), "lon", "lat", "lev", "dat", (F.col("err") * 0.1).alias("err"), F.lit(3.0).alias("platform"), F.lit(0.25).alias("time"), F.col("lev").alias("ohx"), (F.col("obs_id") % 3).cast("int").alias("qc"))
    place = scratch_folder(spark)
    gridded.write_records(rows, place, extended=True)
    back = records.read_records(spark, place, "coupled")
    return back.groupBy("id", "qc").agg(F.count("*").alias("n"), r(F.sum("dat"), 4).alias("dat"), r(F.sum("err"), 4).alias("err"))


# ---- times: leap seconds, and swaths whose lines have a time here and there

_LEAPS = f"(SELECT list(epoch(d::TIMESTAMP)::BIGINT - epoch(TIMESTAMP '1993-01-01')::BIGINT + k - 18 ORDER BY k) FROM (SELECT unnest({times.LEAP_DATES}) AS d, generate_subscripts({times.LEAP_DATES}, 1) AS k))"


@query(f"""WITH l AS (SELECT {_LEAPS} AS leaps), x AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 1440) * INTERVAL 1 MINUTE AS m, o_orderkey % 61 + 0.25::DOUBLE AS s, leaps, leaps[o_orderkey % 27 + 1] + o_orderkey % 5 - 2 + 0.25::DOUBLE AS tai FROM orders, l),
y AS (SELECT *, epoch(m)::BIGINT - epoch(TIMESTAMP '1993-01-01')::BIGINT AS u, tai - (len(list_filter(leaps, lambda x: tai >= x + 1)) - 17) AS v, len(list_filter(leaps, lambda x: tai >= x AND tai < x + 1)) AS extra FROM x)
SELECT o_orderkey, round(u + s + len(list_filter(leaps, lambda x: u >= x - len(list_filter(leaps, lambda z: z < x)) + 17)) - 17, 3) AS tai93,
  strftime(TIMESTAMP '1993-01-01' + floor((v - extra) / 60)::BIGINT * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS minute, round(v - extra - floor((v - extra) / 60) * 60 + extra, 3) AS second FROM y""")
def atomic_times(spark, d):
    """Atomic seconds of the times of orders, and the times of seconds around each leap."""
    o = t.read(spark, d, "orders")
    k = F.col("o_orderkey")
    minute = F.timestamp_add("MINUTE", (k % 1440).cast("long"), F.col("o_orderdate").cast("timestamp_ntz"))
    tai = F.get(F.array(*[F.lit(x).cast("long") for x in times.leap_starts()]), (k % 27).cast("int")) + k % 5 - 2 + 0.25
    out = o.select("o_orderkey", r(times.utc_to_tai93(minute, k % 61 + 0.25), 3).alias("tai93"), times.tai93_to_utc(tai).alias("u"))
    return out.select("o_orderkey", "tai93", F.date_format("u.minute", "yyyy-MM-dd HH:mm").alias("minute"), r("u.second", 3).alias("second"))


@query("""WITH p AS (SELECT o_orderkey AS pixel, o_custkey % 50 AS swath, o_orderkey % 40 AS line, CASE WHEN o_orderkey % 11 = 0 THEN -9999.0::DOUBLE ELSE o_orderkey % 360 END AS lon, o_totalprice / 10000 AS sss, (o_orderkey % 30) / 10.0::DOUBLE AS err, (o_orderkey % 6 * 512)::INT AS flags FROM orders),
l AS (SELECT DISTINCT swath, line, CASE WHEN line % 8 = 0 THEN swath * 1000 + line * 37.3::DOUBLE + line * line * 0.7::DOUBLE END AS s FROM p),
n AS (SELECT *, last_value(CASE WHEN s IS NOT NULL THEN line END IGNORE NULLS) OVER a AS l0, last_value(s IGNORE NULLS) OVER a AS s0, first_value(CASE WHEN s IS NOT NULL THEN line END IGNORE NULLS) OVER b AS l1, first_value(s IGNORE NULLS) OVER b AS s1 FROM l
  WINDOW a AS (PARTITION BY swath ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY swath ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT swath, line, ceil(s0 + CASE WHEN l1 = l0 THEN 0 ELSE (line - l0) / (l1 - l0) END * (s1 - s0)) AS t FROM n)
SELECT pixel, t::BIGINT AS seconds, round(sss, 6) AS dat, greatest(err, 0.2::DOUBLE) AS err FROM p JOIN c USING (swath, line)
WHERE abs(t - 20000) <= 9000 AND flags & 1023 = 0 AND err <= 2 AND sss BETWEEN 2 AND 38.5 AND err BETWEEN 0.1 AND 1.75 AND round(lon) <> -9999""")
def timed_salinity_swaths(spark, d):
    """Pixels of swaths within a window of the times of their lines, inside of the file's ranges, without flags and fill values."""
    k = F.col("o_orderkey")
    o = t.read(spark, d, "orders")
    px = o.select(k.alias("pixel"), (F.col("o_custkey") % 50).alias("swath"), (k % 40).alias("line"), F.when(k % 11 == 0, -9999.0).otherwise((k % 360).cast("double")).alias("lon"), F.lit(0.0).alias("lat"), (F.col("o_totalprice") / 10000).alias("sss"), (k % 30 / 10).alias("err"), (k % 6 * 512).cast("int").alias("flags"))
    line = F.col("line")
    lines = px.select("swath", "line").distinct().withColumn("seconds", F.when(line % 8 == 0, F.col("swath") * 1000 + line * 37.3 + line * line * 0.7))
    centre = times.from_epoch_seconds(F.lit(20000.0), times.EPOCHS["salinity"])
    timed = decoders.timed_swath(px, lines, centre, 9000.0)
    out = decoders.swath_salinity(timed, ["pixel", "time"], (2.0, 38.5), (0.1, 1.75), -9999.0)
    seconds = F.timestamp_diff("SECOND", F.lit(times.EPOCHS["salinity"]).cast("timestamp_ntz"), F.col("time"))
    return out.select("pixel", seconds.alias("seconds"), r("dat").alias("dat"), "err")
