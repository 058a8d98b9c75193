"""Queries of the observation operators, masks, matches and source rules, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics, interpolation, masks, matching, quality_control, transform
from ..schema import FilterConfig
from ..sources import decoders
from . import observation_operators as programs
from . import tables as t
from .registry import query, r

_GRID = programs.Settings(nlon=36, nlat=18, nlev=5)

# ---- fixtures: observations with indexes on the grid of ``field``, and fields of five levels


def _placed(spark, d) -> DataFrame:
    x = t.observations(spark, d).withColumn("err", F.col("err") - 1.0)
    return x.withColumns({"ri": (F.col("lon") - 5.0) / 10 + 1, "rj": (F.col("lat") + 85.0) / 10 + 1, "rk": F.col("lev") / 100 + 1})


def _grid(spark, d) -> DataFrame:
    return t.field(spark, d).select("i", "j", "lon", "lat", (F.col("kmt") + F.when(F.col("i") % 5 > 0, 2).otherwise(0)).alias("kmt"))


def _state(spark, d) -> DataFrame:
    """t and s of every cell and level."""
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    return t.field(spark, d).select("i", "j", k.alias("k"), "value").select("i", "j", "k", (F.col("value") / 997 - F.col("k")).alias("t"), (F.col("value") / 7919 + 34.0 + F.col("k") * 0.1).alias("s"))


_FIXTURE = f"""{t.OBS}, {t.FIELD},
placed AS (SELECT obs_id, elem, lon, lat, lev, dat, err - 1 AS err, flags, slot, (lon - 5.0::DOUBLE) / 10 + 1 AS ri, (lat + 85.0::DOUBLE) / 10 + 1 AS rj, lev / 100 + 1 AS rk FROM obs),
grd AS (SELECT i, j, lon, lat, kmt + CASE WHEN i % 5 > 0 THEN 2 ELSE 0 END AS kmt FROM field),
state AS (SELECT i, j, k, value / 997 - k AS t, value / 7919 + 34.0::DOUBLE + k * 0.1::DOUBLE AS s FROM field, range(1, 6) AS x(k))"""


def _observed(source: str, field: str, three_d: bool, mask: int = 2, first: str = "", later: str = "", value: str = "value") -> str:
    """CTEs up to ``done`` (obs_id, dat, err, oqc, ohx, reason) of the shared chain."""
    depth = "CASE WHEN ceil(rk) < 2 AND rk < 1.00001 THEN 1.00001::DOUBLE ELSE rk END" if three_d else "1.0::DOUBLE"
    levels = "(VALUES (0), (1)) AS v3(e)" if three_d else "(VALUES (0)) AS v3(e)"
    weight = "(CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END)"
    weight += " * (CASE e WHEN 1 THEN rk - floor(rk) ELSE 1 - (rk - floor(rk)) END)" if three_d else ""
    land = {0: "", 1: "WHEN coalesce(near.kmt, 0) < 1 THEN 'near_land' WHEN near.kmt < c.rk THEN 'topography'", 2: "WHEN met.kmt < 1 THEN 'near_land' WHEN met.kmt < c.rk THEN 'topography'"}[mask]
    return f"""src AS ({source}), lv AS (SELECT * REPLACE ({depth} AS rk) FROM src),
c AS (SELECT *, CASE WHEN err <= 0 THEN 'error' {first} WHEN lon > 25 AND lon < 45 AND lat > 40 AND lat < 50 THEN 'enclosed_sea'
  WHEN ceil(ri) < 2 OR ceil(ri) > 37 THEN 'x_outside' WHEN ceil(rj) < 2 OR ceil(rj) > 18 THEN 'y_outside' WHEN ceil(rk) > 5 THEN 'z_outside' END AS r0 FROM lv),
q AS (SELECT obs_id, elem, (floor(ri)::INT + a - 1) % 36 + 1 AS i, floor(rj)::INT + b AS j, floor(rk)::INT + e AS k, {weight} AS w
  FROM c, (VALUES (0), (1)) AS v1(a), (VALUES (0), (1)) AS v2(b), {levels} WHERE r0 IS NULL),
met AS (SELECT q.obs_id, min(coalesce(g.kmt, 0)) AS kmt, CASE WHEN count(f.{value}) = count(*) THEN sum(w * f.{value}) END AS hx
  FROM q LEFT JOIN {field} LEFT JOIN grd g ON q.i = g.i AND q.j = g.j WHERE w > 0 GROUP BY q.obs_id),
near AS (SELECT c.obs_id, g.kmt FROM c LEFT JOIN grd g ON g.i = (round(ri)::INT + 35) % 36 + 1 AND g.j = round(rj)::INT),
done AS (SELECT c.*, met.hx, CASE WHEN r0 IS NOT NULL THEN r0 {land} WHEN hx IS NULL THEN 'no_model' {later} END AS reason
  FROM c LEFT JOIN met ON c.obs_id = met.obs_id LEFT JOIN near ON c.obs_id = near.obs_id)"""


_DEEP = "state f ON q.i = f.i AND q.j = f.j AND q.k = f.k"
_FLAT = "field f ON q.i = f.i AND q.j = f.j"
_RESULT = "SELECT obs_id, coalesce(reason, 'accepted') AS reason, round(CASE WHEN reason IS NULL THEN hx END, 7) AS ohx, round(CASE WHEN reason IS NULL THEN err * {scale}::DOUBLE ELSE err END, 7) AS err FROM done"


def _result(x: DataFrame) -> DataFrame:
    return x.select("obs_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), r("ohx", 7).alias("ohx"), r("err", 7).alias("err"))


# ---- observation operators


@query(f"WITH {_FIXTURE}, {_observed('SELECT * FROM placed WHERE elem = 3073', _DEEP, True, value='t')} {_RESULT.format(scale=1.5)}")
def temperature_profile_operator(spark, d):
    s = programs.Settings(36, 18, 5, error_scale=1.5)
    return _result(programs.temperature_profiles(_placed(spark, d).where("elem = 3073"), _state(spark, d), _grid(spark, d), s))


@query(f"WITH {_FIXTURE}, {_observed('SELECT * FROM placed WHERE elem = 3073', _DEEP, True, mask=1, value='t')} {_RESULT.format(scale=1.0)}")
def temperature_profile_operator_nearest_mask(spark, d):
    s = programs.Settings(36, 18, 5, mask=1)
    return _result(programs.temperature_profiles(_placed(spark, d).where("elem = 3073"), _state(spark, d), _grid(spark, d), s))


def _lapse(temp: str, pressure: str) -> str:
    """The adiabatic lapse rate (Bryden 1973) in SQL; salinity is x."""
    poly = lambda *c: "(" + " + ".join(f"{v!r}::DOUBLE * pow({temp}, {k})" for k, v in enumerate(c)) + ")"
    # Published coefficients.
    return f"""({poly(3.5803e-5, 8.5258e-6, -6.836e-8, 6.6228e-10)} + {poly(1.8932e-6, -4.2393e-8)} * (x - 35)
 + ({poly(1.8741e-8, -6.7795e-10, 8.733e-12, -5.4481e-14)} + {poly(-1.1351e-10, 2.7759e-12)} * (x - 35) + {poly(-4.6206e-13, 1.8676e-14, -2.1687e-16)} * {pressure}) * {pressure})"""


#: Pressures of the observations stay under 1000 decibars: one step of the integration.
_IN_SITU = f"""p AS (SELECT a.obs_id, a.reason, a.err, a.hx AS t, b.hx AS x, 1 - (5.92e-3::DOUBLE + pow(sin(abs(a.lat) * (3.141592654::DOUBLE / 180)), 2) * 5.25e-3::DOUBLE) AS c, a.lev FROM a JOIN b ON a.obs_id = b.obs_id),
h AS (SELECT *, (c - sqrt(c * c - 8.84e-6::DOUBLE * lev)) / 4.42e-6::DOUBLE AS h, sqrt(0.5::DOUBLE) AS r FROM p),
s1 AS (SELECT *, h * {_lapse('t', '0')} AS k1 FROM h), s2 AS (SELECT *, h * {_lapse('(t + 0.5 * k1)', '(0.5 * h)')} AS k2 FROM s1),
s3 AS (SELECT *, t + 0.5 * k1 + (1 - r) * (k2 - k1) AS t2, (2 - 2 * r) * k2 + (3 * r - 2) * k1 AS q2 FROM s2), s4 AS (SELECT *, h * {_lapse('t2', '(0.5 * h)')} AS k3 FROM s3),
s5 AS (SELECT *, t2 + (1 + r) * (k3 - q2) AS t3, (2 + 2 * r) * k3 - (3 * r + 2) * q2 AS q3 FROM s4), s6 AS (SELECT *, h * {_lapse('t3', 'h')} AS k4 FROM s5)"""


@query(f"""WITH {_FIXTURE}, a AS (WITH {_observed('SELECT * FROM placed WHERE elem = 3073', _DEEP, True, value='t')} SELECT * FROM done),
b AS (WITH {_observed('SELECT * FROM placed WHERE elem = 3073', _DEEP, True, value='s')} SELECT * FROM done), {_IN_SITU}
SELECT obs_id, coalesce(reason, 'accepted') AS reason, round(CASE WHEN reason IS NULL THEN t3 + (k4 - 2 * q3) / 6 END, 7) AS ohx, round(err, 7) AS err FROM s6""")
def converted_temperatures(spark, d):
    """Model potential temperatures at the observations as in-situ temperatures."""
    return _result(programs.temperature_profiles(_placed(spark, d).where("elem = 3073"), _state(spark, d), _grid(spark, d), _GRID, convert="model"))


@query(f"WITH {_FIXTURE}, {_observed('SELECT * FROM placed WHERE elem = 5521', _DEEP, True, value='s')} {_RESULT.format(scale=1.0)}")
def salinity_profile_operator(spark, d):
    field = _state(spark, d).withColumnRenamed("s", "value")
    return _result(programs.salinity_profiles(_placed(spark, d).where("elem = 5521"), field, _grid(spark, d), _GRID))


_ETA = _observed("SELECT * REPLACE (err + 0.25::DOUBLE AS err) FROM placed WHERE elem = 5351", _FLAT, False, later="WHEN abs(hx) < 1e-12 AND dat > 0.1 THEN 'zero_model' WHEN abs(dat - hx) > 4500 THEN 'departure'")


@query(f"WITH {_FIXTURE}, {_ETA} SELECT obs_id, coalesce(reason, 'accepted') AS reason, round(dat - (SELECT avg(dat - hx) FROM done WHERE reason IS NULL), 5) AS dat, err FROM done")
def absolute_sea_level_operator(spark, d):
    s = programs.Settings(36, 18, 5, least_error=0.25, zero_model=True, most_departure=4500.0)
    x = programs.sea_level(_placed(spark, d).where("elem = 5351"), t.field(spark, d), _grid(spark, d), s)
    return x.select("obs_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), r("dat", 5).alias("dat"), "err")


@query(f"""WITH {_FIXTURE}, {_observed('''SELECT p.* REPLACE (CASE WHEN f.value > 5000 THEN f.value / 1000 - 4 ELSE p.err + 0.25::DOUBLE END AS err) FROM placed p
  LEFT JOIN field f ON f.i = (round(ri)::INT + 35) % 36 + 1 AND f.j = round(rj)::INT WHERE elem = 5351''', _FLAT, False)} {_RESULT.format(scale=1.0)}""")
def sea_level_anomaly_operator(spark, d):
    """Errors of a grid replace those of the file where they are positive."""
    errors = t.field(spark, d).select("i", "j", F.when(F.col("value") > 5000, F.col("value") / 1000 - 4).otherwise(-1.0).alias("value"))
    s = programs.Settings(36, 18, 5, least_error=0.25)
    return _result(programs.sea_level(_placed(spark, d).where("elem = 5351"), t.field(spark, d), _grid(spark, d), s, errors, absolute=False))


@query(f"""WITH {_FIXTURE}, {_observed('''SELECT (g.j - 1) * 36 + g.i AS obs_id, 5525 AS elem, g.lon, g.lat, 0 AS lev, n.dat, n.err, g.i::DOUBLE AS ri, g.j::DOUBLE AS rj, 1.0::DOUBLE AS rk
  FROM (SELECT floor(lon / 10)::INT + 1 AS i, floor((lat + 90) / 10)::INT + 1 AS j, avg(dat) AS dat, 0.5::DOUBLE + stddev_samp(dat) AS err FROM obs GROUP BY 1, 2 HAVING count(dat) > 1) n
  JOIN grd g ON n.i = g.i AND n.j = g.j WHERE g.kmt >= 1''', _FLAT, False)} {_RESULT.format(scale=1.0).replace(', 7) AS err', ', 4) AS err').replace(', 7) AS ohx', ', 5) AS ohx')}""")
def surface_temperature_operator(spark, d):
    x = programs.surface_temperature(t.observations(spark, d).select("lon", "lat", "dat"), t.field(spark, d), _grid(spark, d), _GRID, 10.0, 0.5)
    return x.select("obs_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), r("ohx", 5).alias("ohx"), r("err", 4).alias("err"))


@query(f"WITH {_FIXTURE}, {_observed('SELECT * FROM placed WHERE elem = 5522', _FLAT, False, mask=0).replace('''WHEN ceil(ri) < 2''', '''WHEN abs(lat) < 20 THEN 'latitude_band' WHEN ceil(ri) < 2''', 1)} {_RESULT.format(scale=1.0)}")
def ice_fraction_operator(spark, d):
    s = programs.Settings(36, 18, 5, mask=0, latitude_band=20.0)
    return _result(programs.observe(_placed(spark, d).where("elem = 5522"), t.field(spark, d), _grid(spark, d), s, False))


_SUPPLIED = """SELECT obs_id, CASE WHEN err <= 0 THEN 'error' WHEN abs(dat - hx) > 150 THEN 'departure' WHEN lat > 65 THEN 'north' WHEN lon > 25 AND lon < 45 AND lat > 40 AND lat < 50 THEN 'enclosed_sea'
  WHEN hx IS NULL THEN 'no_model' ELSE 'accepted' END AS reason, round(hx, 6) AS hx FROM fb"""


@query(f"WITH {_FIXTURE}, fb AS (SELECT obs_id, lon, lat, dat, CASE WHEN flags % 3 = 0 THEN 1.0::DOUBLE ELSE err END AS err, CASE WHEN flags % 10 > 0 THEN lev + 100 END AS hx FROM placed) {_SUPPLIED}")
def feedback_operator(spark, d):
    """Profiles in arrays with H(x) beside each value, as feedback files have them; the error is computed for a third."""
    x = _placed(spark, d)
    files = x.select("obs_id", "lon", "lat", F.array("dat").alias("values"), F.array(F.when(F.col("flags") % 10 > 0, F.col("lev") + 100)).alias("model"), F.array("lev").alias("depths"), F.array(F.when(F.col("flags") % 3 != 0, F.col("err"))).alias("errors"))
    rows = decoders.feedback_levels(files, default_error=1.0)
    out = programs.supplied(rows, programs.Settings(36, 18, 5, remove_north=True, most_departure=150.0))
    return out.join(rows.select("obs_id", "hx"), "obs_id").select("obs_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), r("hx").alias("hx"))


@query(f"WITH {_FIXTURE}, fb AS (SELECT obs_id, lon, lat, dat, err, dat - (lev - 200) AS hx FROM placed WHERE obs_id % 4 < 2) {_SUPPLIED}")
def innovation_operator(spark, d):
    """Values and member innovations in two tables, matched by record."""
    x = _placed(spark, d)
    records = x.select(F.col("obs_id").alias("rid"), "obs_id", (F.col("obs_id") % 4 + 1).alias("kind"), "lon", "lat", "dat", "err")
    innovations = x.select(F.col("obs_id").alias("rid"), F.array(F.lit(0.0), F.col("lev") - 200).alias("innovation"))
    rows = matching.by_record(records, innovations, 2)
    out = programs.supplied(rows, programs.Settings(36, 18, 5, remove_north=True, most_departure=150.0))
    return out.join(rows.select("obs_id", "hx"), "obs_id").select("obs_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), r("hx").alias("hx"))


@query(f"""WITH {_FIXTURE}, f3 AS (SELECT 3073 AS elem, i, j, k, t AS value FROM state UNION ALL SELECT 5521, i, j, k, s FROM state),
a AS (WITH {_observed('SELECT * FROM placed WHERE elem IN (3073, 5521)', 'f3 f ON q.i = f.i AND q.j = f.j AND q.k = f.k AND q.elem = f.elem', True)} SELECT * FROM done),
f2 AS (SELECT e AS elem, i, j, value + e AS value FROM field, (VALUES (5351), (5522), (5525)) AS v(e)),
b AS (WITH {_observed('SELECT * FROM placed WHERE elem IN (5351, 5522, 5525)', 'f2 f ON q.i = f.i AND q.j = f.j AND q.elem = f.elem', False)} SELECT * FROM done),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT elem, coalesce(reason, 'accepted') AS reason, count(*) AS n, round(sum(CASE WHEN reason IS NULL THEN hx END), 5) AS ohx FROM u GROUP BY 1, 2""")
def dispatched_operator(spark, d):
    s = _state(spark, d)
    deep = s.select(F.lit(3073).alias("elem"), "i", "j", "k", F.col("t").alias("value")).union(s.select(F.lit(5521), "i", "j", "k", "s"))
    flat = t.field(spark, d).withColumn("elem", F.explode(F.array(*map(F.lit, (5351, 5522, 5525))))).select("elem", "i", "j", (F.col("value") + F.col("elem")).alias("value"))
    x = programs.dispatched(_placed(spark, d), deep, flat, _grid(spark, d), _GRID)
    return x.groupBy("elem", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), r(F.sum("ohx"), 5).alias("ohx"))


# ---- masks, matches, filters


@query(f"WITH {t.FIELD} SELECT i, j, coalesce(max(CASE WHEN value / 1000 - k > 0.001 AND (i + k) % 7 > 0 THEN k END), 0)::INT AS kmt FROM field, range(1, 6) AS x(k) GROUP BY i, j")
def levels_of_water(spark, d):
    x = t.field(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return masks.wet_levels(x.select("i", "j", "k", (F.col("value") / 1000 - F.col("k")).alias("h"), ((F.col("i") + F.col("k")) % 7).alias("wet")), ["i", "j"])


@query(f"""WITH {_FIXTURE}, m AS (SELECT s.*, CASE WHEN t >= -10 AND s >= 3 AND k <= kmt AND (s.i % 3) / 2.0::DOUBLE >= 0.5 THEN true ELSE false END AS keep FROM state s JOIN grd g ON s.i = g.i AND s.j = g.j)
SELECT i, count(CASE WHEN keep THEN t END) AS n, round(sum(CASE WHEN keep THEN t END), 6) AS t, round(sum(CASE WHEN keep THEN s END), 6) AS s FROM m GROUP BY i""")
def masked_states(spark, d):
    x = _state(spark, d).join(_grid(spark, d).select("i", "j", "kmt"), ["i", "j"]).withColumn("olmask", (F.col("i") % 3) / 2.0)
    return masks.masked_state(x, F.col("kmt")).groupBy("i").agg(F.count("t").alias("n"), r(F.sum("t")).alias("t"), r(F.sum("s")).alias("s"))


@query(f"WITH {_FIXTURE} SELECT count(CASE WHEN t < -5 OR t > 32 THEN 1 END) AS n_t, count(CASE WHEN s < 2 OR s > 42 THEN 1 END) AS n_s FROM state")
def values_out_of_range(spark, d):
    return masks.out_of_range(_state(spark, d))


@query(f"WITH {t.OBS} SELECT elem, CASE elem WHEN 3073 THEN 1.0 WHEN 5525 THEN 0.5 WHEN 5351 THEN 0.25 END::DOUBLE AS var_weight, count(*) AS n FROM obs WHERE elem IN (3073, 5525, 5351) GROUP BY elem")
def variable_localisation(spark, d):
    x = masks.localised_by_variable(t.observations(spark, d), [0.0, 0.0, 1.0, 0.0, 0.0, 0.5, 0.0, 0.25, 0.0])
    return x.groupBy("elem", "var_weight").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS file FROM orders WHERE o_orderdate::DATE <= DATE '1995-06-10' AND o_orderdate::DATE + INTERVAL 9 DAY >= DATE '1995-06-01'")
def files_of_a_week(spark, d):
    x = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderdate").cast("date").alias("start"))
    return masks.overlapping(x.withColumn("end", F.date_add("start", 9)), F.lit("1995-06-01").cast("date"), F.lit("1995-06-10").cast("date")).select("file")


@query(f"WITH {t.OBS}, ranked AS (SELECT obs_id, dat, lev FROM obs WHERE elem = 3073) SELECT obs_id, round(dat, 6) AS t, round(lev / 10 + 30, 6) AS s FROM ranked")
def matched_salinity(spark, d):
    """Temperature and salinity files with the same rows; a missing partner would be an error."""
    x = t.observations(spark, d).where("elem = 3073")
    both = matching.one_to_one(x.select("obs_id", r("dat").alias("t")), x.select("obs_id", r(F.col("lev") / 10 + 30).alias("s")), ["obs_id"])
    return both.select("obs_id", "t", "s")


@query("""WITH b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def drifter_as_of(spark, d):
    """The latest fix of each drifter at the time of each observation."""
    e = t.read(spark, d, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    fixes = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return matching.as_of(views, fixes, "user_id", "ts", ["last_value"]).select("event_id", "last_value")


@query(f"WITH {t.OBS} SELECT obs_id, round((lon + 5) / 10, 6) AS ri, round((lat + 95) / 10, 6) AS rj FROM obs")
def curvilinear_indexes(spark, d):
    """On a regular grid the index of the curvilinear rule is that of the axes, also in the middle between two cells."""
    o = t.observations(spark, d).select("obs_id", "lon", "lat")
    n = F.col("id")
    grid = spark.range(648).select((n % 36 + 1).cast("int").alias("i"), (F.floor(n / 36) + 1).cast("int").alias("j"), (n % 36 * 10.0 + 5.0).alias("lon"), (F.floor(n / 36) * 10.0 - 85.0).alias("lat"))
    x = matching.curvilinear_index(o, grid, 36, 1_500_000.0)
    # The same longitude has two names: 0.5 and 36.5.
    return x.select("obs_id", r(F.when(F.col("lon") < 5, F.when(F.col("ri") > 36, F.col("ri") - 36).otherwise(F.col("ri"))).otherwise(F.col("ri"))).alias("ri"), r("rj").alias("rj"))


# ---- interpolation


@query(f"""WITH {t.PROFILES}, p AS (SELECT profile, row_number() OVER (PARTITION BY profile ORDER BY depth) AS m, depth AS x, level * 3 % 7 + profile % 5 AS y FROM profiles),
z AS (SELECT *, count(*) OVER (PARTITION BY profile) AS n, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM p WINDOW w AS (PARTITION BY profile ORDER BY m)),
big AS (SELECT * FROM z WHERE n >= 3),
s0 AS (SELECT profile, m, s FROM big WHERE s IS NOT NULL
  UNION ALL SELECT profile, 0, max(s) FILTER (m = 1) + (max(s) FILTER (m = 1) - max(s) FILTER (m = 2)) FROM big GROUP BY profile
  UNION ALL SELECT profile, -1, max(s) FILTER (m = 1) + 2 * (max(s) FILTER (m = 1) - max(s) FILTER (m = 2)) FROM big GROUP BY profile
  UNION ALL SELECT profile, max(n), max(s) FILTER (m = n - 1) + (max(s) FILTER (m = n - 1) - max(s) FILTER (m = n - 2)) FROM big GROUP BY profile
  UNION ALL SELECT profile, max(n) + 1, max(s) FILTER (m = n - 1) + 2 * (max(s) FILTER (m = n - 1) - max(s) FILTER (m = n - 2)) FROM big GROUP BY profile),
d AS (SELECT profile, m, s, lag(s) OVER w AS s1, lag(s, 2) OVER w AS s2, lead(s) OVER w AS sn FROM s0 WINDOW w AS (PARTITION BY profile ORDER BY m)),
tg AS (SELECT profile, m, s, CASE WHEN abs(sn - s) + abs(s1 - s2) = 0 THEN 0 ELSE (abs(sn - s) * s1 + abs(s1 - s2) * s) / (abs(sn - s) + abs(s1 - s2)) END AS t FROM d),
k AS (SELECT b.profile, b.x, b.y, tg.s, tg.t, lead(b.x) OVER w - b.x AS dx, lead(tg.t) OVER w AS t2 FROM big b JOIN tg ON b.profile = tg.profile AND b.m = tg.m WINDOW w AS (PARTITION BY b.profile ORDER BY b.m))
SELECT profile, z, round(y + (z - x) * t + (z - x) * (z - x) * (3 * s - 2 * t - t2) / dx + (z - x) * (z - x) * (z - x) * (t + t2 - 2 * s) / dx / dx, 6) AS value
FROM k, (VALUES (12.142857::DOUBLE), (23.714286::DOUBLE), (34.285714::DOUBLE)) AS v(z) WHERE z >= x AND z < x + dx""")
def akima_profiles(spark, d):
    p = t.profiles(spark, d).select("profile", F.col("depth").alias("x"), (F.col("level") * 3 % 7 + F.col("profile") % 5).cast("double").alias("y"))
    z = p.select("profile").distinct().withColumn("z", F.explode(F.array(F.lit(12.142857), F.lit(23.714286), F.lit(34.285714))))
    return interpolation.akima(p, z, "profile").where("value is not null").select("profile", "z", r("value").alias("value"))


@query(f"""WITH {t.OBS}, {t.FIELD}, top AS (SELECT avg(value) AS value FROM field WHERE j = 18),
o AS (SELECT obs_id, (lon + 5) / 10 AS ri, (lat * 1.5::DOUBLE + 95) / 10 AS rj FROM obs),
q AS (SELECT obs_id, rj, (floor(ri)::INT + a + 35) % 36 + 1 AS i, floor(rj)::INT + b AS j, (CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN rj - floor(rj) ELSE 1 - (rj - floor(rj)) END) AS w
  FROM o, (VALUES (0), (1)) AS v1(a), (VALUES (0), (1)) AS v2(b)),
m AS (SELECT obs_id, max(rj) AS rj, CASE WHEN count(value) = count(*) THEN sum(w * value) END AS hx FROM q LEFT JOIN field f ON q.i = f.i AND q.j = f.j WHERE w > 0 GROUP BY obs_id)
SELECT obs_id, round(CASE WHEN rj > 18 THEN (SELECT value FROM top) ELSE hx END, 7) AS value FROM m""")
def regridded_with_polar_row(spark, d):
    o = t.observations(spark, d).select("obs_id", ((F.col("lon") + 5) / 10).alias("ri"), ((F.col("lat") * 1.5 + 95) / 10).alias("rj"))
    return interpolation.bilinear_polar(o, t.field(spark, d), 36, 18).select("obs_id", r("hx", 7).alias("value"))


# ---- diagnostics and sources


@query(f"WITH {t.ENS}, p AS (SELECT elem, list_transform(hx, lambda x: x - list_sum(hx) / len(hx)) AS p FROM ens) SELECT elem, round(max(list_max(list_transform(p, lambda x: abs(x)))), 7) AS largest, max(list_max(list_transform(p, lambda x: abs(x)))) > 2.220446049250313e-16 AS diverse FROM p GROUP BY elem")
def ensemble_diversity(spark, d):
    x = diagnostics.diversity(t.ensemble_observations(spark, d), "hx", ["elem"])
    return x.select("elem", r("largest", 7).alias("largest"), "diverse")


@query(f"""WITH {t.OBS}, a AS (SELECT obs_id, CASE elem WHEN 3073 THEN 1210 WHEN 5521 THEN 1221 WHEN 5525 THEN 1100 ELSE elem END AS elem, lev, dat, err FROM obs)
SELECT obs_id, elem, CASE WHEN elem IN (1210, 1221) THEN lev * 100 ELSE lev END AS lev, CASE elem WHEN 1221 THEN dat * 0.01::DOUBLE WHEN 1100 THEN dat * 100 ELSE dat END AS dat,
 CASE elem WHEN 1221 THEN err * 0.01::DOUBLE WHEN 1100 THEN err * 100 ELSE err END AS err FROM a""")
def converted_units(spark, d):
    kind = F.when(F.col("elem") == 3073, 1210).when(F.col("elem") == 5521, 1221).when(F.col("elem") == 5525, 1100).otherwise(F.col("elem"))
    return decoders.pascals(t.observations(spark, d).select("obs_id", kind.alias("elem"), "lev", "dat", "err"))


@query(f"WITH {t.OBS} SELECT obs_id, round(dat - 273.15::DOUBLE, 6) AS dat, round((hour(ts) + minute(ts) / 60.0::DOUBLE), 6) AS obhr FROM obs WHERE dat - 273.15::DOUBLE > -4 AND dat - 273.15::DOUBLE < 50")
def profile_messages(spark, d):
    x = t.observations(spark, d).select("obs_id", F.col("dat").alias("kelvin"), F.hour("ts").alias("hour"), F.minute("ts").alias("minute"))
    return decoders.message_levels(x).select("obs_id", r("dat").alias("dat"), r("obhr").alias("obhr"))


@query(f"""WITH {t.OBS}, nav AS (SELECT user_id AS pixel, any_value(user_id * 2 - 90)::DOUBLE AS nlat, any_value(user_id * 3)::DOUBLE AS nlon FROM events GROUP BY 1),
p AS (SELECT event_id AS obs_id, user_id AS pixel, value AS sst, event_id % 6 AS quality FROM events)
SELECT obs_id, nlon AS lon, nlat AS lat, round(sst - 273.15::DOUBLE, 6) AS dat FROM p JOIN nav USING (pixel) WHERE quality >= 4""")
def geostationary_pixels(spark, d):
    e = t.read(spark, d, "events")
    pixels = e.select(F.col("event_id").alias("obs_id"), F.col("user_id").alias("pixel"), F.col("value").alias("sst"), (F.col("event_id") % 6).alias("quality"))
    nav = e.select(F.col("user_id").alias("pixel")).distinct().select("pixel", (F.col("pixel") * 2 - 90).cast("double").alias("lat"), (F.col("pixel") * 3).cast("double").alias("lon"))
    return decoders.geostationary(pixels, nav, 4).select("obs_id", "lon", "lat", r("dat").alias("dat"))


@query(f"WITH {t.OBS} SELECT obs_id, 5525 AS elem, round(dat - 273.15::DOUBLE, 6) AS dat FROM obs WHERE flags % 8 >= 4 UNION ALL SELECT obs_id, 6282, round(lev / 400, 6) FROM obs WHERE flags % 8 >= 4")
def pathfinder_pixels(spark, d):
    x = t.observations(spark, d).select("obs_id", "lon", "lat", F.col("dat").alias("sst"), (F.col("lev") / 400).alias("ice"), (F.col("flags") % 8).alias("quality"))
    both = decoders.pathfinder(x, 4).unionByName(decoders.pathfinder(x, 4, ice=True))
    return both.select("obs_id", "elem", r("dat").alias("dat"))


@query(f"WITH {t.FIELD} SELECT i, 19 - j AS j, round(value / 100, 6) AS dat FROM field WHERE value >= 0 AND value <= 100 * 100")
def ice_rasters(spark, d):
    """Lines of a text raster, north first, with fractions in per cent."""
    f = t.field(spark, d)
    lines = f.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("a")).select(F.col("j").alias("line"), F.transform("a", lambda x: F.struct(x["i"].alias("i"), x["value"].alias("percent"))).alias("cells"))
    return decoders.ice_lines(lines, 18, 10000.0).select("i", "j", r(F.col("dat") * 100).alias("dat"))


@query(f"WITH {t.OBS}, x AS (SELECT obs_id, lon, lat, dat, CASE WHEN flags % 2 = 0 THEN 0.0005::DOUBLE ELSE 0.2::DOUBLE END AS land, CASE WHEN flags % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS ice FROM obs) SELECT obs_id, dat, 0.3::DOUBLE AS err FROM x WHERE land < 0.001 AND ice < 0.001")
def salinity_cells(spark, d):
    x = t.observations(spark, d).select("obs_id", "lon", "lat", F.col("dat").alias("sss"), F.when(F.col("flags") % 2 == 0, 0.0005).otherwise(0.2).alias("land"), F.when(F.col("flags") % 3 == 0, 0.0).otherwise(0.5).alias("ice"))
    return decoders.gridded_salinity(x, 0.3, ["obs_id"]).select("obs_id", "dat", "err")


@query(f"WITH {t.OBS} SELECT obs_id, dat, round((obs_id * 0.37::DOUBLE - floor(obs_id * 0.37::DOUBLE)) * 24, 5) AS obhr FROM obs WHERE dat < 300")
def altimeter_tracks(spark, d):
    x = t.observations(spark, d).select("obs_id", "lon", "lat", (F.col("obs_id") * 0.37).alias("days"), F.col("dat").alias("value"), "err")
    return decoders.altimeter(x, 300.0, ["obs_id"]).select("obs_id", "dat", r("obhr", 5).alias("obhr"))


@query(f"""WITH {t.OBS}, x AS (SELECT flags % 1024 AS f, err / 2 AS e, dat FROM obs) SELECT f AS flags, count(*) AS n, round(sum(dat), 4) AS dat, round(sum(greatest(e, 0.2)), 4) AS err FROM x WHERE f & 1023 = 0 AND e <= 2 GROUP BY f""")
def salinity_swath_flags(spark, d):
    """Flags of the file decide: of the flag words in use only those without a bit stay."""
    x = t.observations(spark, d).select("lon", "lat", F.col("dat").alias("sss"), (F.col("err") / 2).alias("err"), (F.col("flags") % 1024).alias("flags"))
    out = decoders.swath_salinity(x, ["flags"])
    return out.groupBy("flags").agg(F.count("*").alias("n"), r(F.sum("dat"), 4).alias("dat"), r(F.sum("err"), 4).alias("err"))


@query(f"""WITH {t.OBS}, x AS (SELECT obs_id, (err - 1) AS err, lon, lat, dat, CASE WHEN flags % 4 = 0 THEN 0.0::DOUBLE ELSE lev END AS hx FROM obs)
SELECT CASE WHEN err <= 0 THEN 'error' WHEN lon > 25 AND lon < 45 AND lat > 40 AND lat < 50 THEN 'enclosed_sea' WHEN abs(hx) < 1e-12 AND dat > 0.1 THEN 'zero_model' WHEN abs(dat - hx) > 150 THEN 'departure' ELSE 'accepted' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def zero_model_rejects(spark, d):
    x = t.observations(spark, d).withColumn("err", F.col("err") - 1.0).withColumn("hx", F.when(F.col("flags") % 4 == 0, 0.0).otherwise(F.col("lev")))
    checks = quality_control.standard_checks(most_departure=150.0, hx=F.col("hx"))
    return x.groupBy(F.coalesce(quality_control.reject_reason(checks), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {t.FIELD}, b AS (SELECT max(value) AS top FROM field WHERE lon > 100 AND lon < 250 AND lat > -30 AND lat < 30)
SELECT i, j, round(least(value * 2.0::DOUBLE / top, 1.5::DOUBLE), 7) AS value FROM field, b""")
def capped_variances(spark, d):
    return interpolation.scaled_and_capped(t.field(spark, d), (100.0, 250.0, -30.0, 30.0), 2.0, 1.5).select("i", "j", r("value", 7).alias("value"))


@query(f"WITH {t.STATIONS} SELECT point, CASE WHEN kmt < 1 THEN 0.0 WHEN point % 3 = 0 THEN 1.2 ELSE 1.05 END::DOUBLE AS inflation FROM stations")
def inflation_of_points(spark, d):
    own = t.stations(spark, d).withColumn("inflation", F.when(F.col("point") % 3 == 0, 1.2).otherwise(-1.0))
    return transform.inflation_field(own, FilterConfig(inflation=1.05))


@query(f"WITH {t.OBS} SELECT CASE WHEN err - 1 <= 0 THEN true ELSE false END AS marked, count(*) AS n FROM obs GROUP BY 1")
def dumped_observations(spark, d):
    lines = diagnostics.dump(t.observations(spark, d).withColumn("err", F.col("err") - 1.0))
    return lines.groupBy(F.col("line").endswith("bad_error").alias("marked")).agg(F.count("*").alias("n"))
