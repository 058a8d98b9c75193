"""Places on curvilinear grids: the quadrilateral that holds a place, and the place in it.

A cell is the quadrilateral of four neighbouring nodes. The sphere is cut into three
flat charts: longitude and latitude up to CAP degrees, and a stereographic one around
either pole, so that poles, the fold of a tripolar grid and the date line need no
special cases. Cells and places meet by equi-joins on bins of a chart; a cell is
written to the bins that its bounding box touches, a place to one. Within the pair
the bilinear mapping of the quadrilateral is inverted in closed form. A place on an
edge belongs to the cell of the least j, then i.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance
from .interpolation import bilinear_polar
from .spatial import nearest

#: Latitude from which the polar charts hold.
CAP = 60.0
#: How far outside of a cell, as a part of it, rounding may put a place on its edge.
SLACK = 1e-9
_CORNERS = range(4)


def _turn(a: Column) -> Column:
    """An angle as -180 to 180."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def cells(grid: DataFrame, nlon: int, nlat: int, periodic: bool = True, fold: bool = False) -> DataFrame:
    """ci, cj and the corners lon0, lat0 .. lon3, lat3 of each cell: nodes (i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1) of ``grid`` (i, j from 1, lon, lat).

    With ``periodic`` the last node in i is followed by the first. With ``fold`` the
    row beyond the last is the last one in reverse. A node is written to its cells,
    so there is one shuffle and no join; cells that lack a node are left out.
    """
    i, j = F.col("i").cast("int"), F.col("j").cast("int")
    wrap = lambda x: F.pmod(x - 1, F.lit(nlon)) + 1
    if periodic:
        before = wrap(i - 1)
    else:
        before = F.when(i > 1, i - 1)
    own = F.when(F.lit(periodic) | (i < nlon), i)
    top = F.lit(nlat) if fold else F.lit(nlat - 1)
    corner = lambda c, x, y: F.struct(F.lit(c).alias("c"), x.alias("ci"), y.alias("cj"))
    parts = [corner(0, own, F.when(j <= top, j)), corner(1, before, F.when(j <= top, j)), corner(2, own, F.when(j > 1, j - 1)), corner(3, before, F.when(j > 1, j - 1))]
    if fold:
        at_fold = F.when(j == nlat, j)
        parts += [corner(2, nlon + 1 - i, at_fold), corner(3, wrap(nlon - i) if periodic else F.when(i < nlon, nlon - i), at_fold)]
    rows = grid.where("lon is not null and lat is not null").select("lon", "lat", F.explode(F.array(*parts)).alias("n")).select("lon", "lat", "n.*").where("ci is not null and cj is not null")
    pick = lambda name, c: F.max(F.when(F.col("c") == c, F.col(name))).alias(f"{name}{c}")
    whole = rows.groupBy("ci", "cj").agg(F.countDistinct("c").alias("n"), *[pick(name, c) for c in _CORNERS for name in ("lon", "lat")])
    return whole.where("n = 4").drop("n")


def _polar(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Stereographic coordinates around the pole of the hemisphere, in degrees near it."""
    radius = F.tan(F.radians((90.0 - F.abs(lat)) / 2)) * math.degrees(2)
    return radius * F.cos(F.radians(lon)), radius * F.sin(F.radians(lon))


def _charted_cells(quads: DataFrame, step: float) -> DataFrame:
    """Each cell in the charts that it lies in, with flat corners x0, y0 .. and its bins."""
    lats = [F.col(f"lat{c}") for c in _CORNERS]
    low, high = F.least(*lats), F.greatest(*lats)
    tall = high - low
    flat = quads.where((low <= CAP) & (high >= -CAP)).withColumn("chart", F.lit("e"))
    flat = flat.withColumns({f"x{c}": F.col("lon0") + _turn(F.col(f"lon{c}") - F.col("lon0")) for c in _CORNERS} | {f"y{c}": F.col(f"lat{c}") for c in _CORNERS})
    # A cell around a pole has no shape in longitude and latitude.
    xs = [F.col(f"x{c}") for c in _CORNERS]
    flat = flat.where(F.greatest(*xs) - F.least(*xs) <= 180)
    out = [flat]
    for chart, near in (("n", high + tall >= CAP), ("s", low - tall <= -CAP)):
        cap = quads.where(near).withColumn("chart", F.lit(chart))
        # Of a cell across the equator only its own hemisphere would fit; cells that large are not in the cap.
        cap = cap.where(low > 0) if chart == "n" else cap.where(high < 0)
        places = [_polar(F.col(f"lon{c}"), F.col(f"lat{c}")) for c in _CORNERS]
        out.append(cap.withColumns({f"x{c}": places[c][0] for c in _CORNERS} | {f"y{c}": places[c][1] for c in _CORNERS}))
    both = out[0].unionByName(out[1]).unionByName(out[2])
    span = lambda n: F.sequence(F.floor((F.least(*[F.col(f"{n}{c}") for c in _CORNERS]) - 1e-6) / step), F.floor((F.greatest(*[F.col(f"{n}{c}") for c in _CORNERS]) + 1e-6) / step))
    bins = both.withColumn("bx", F.explode(span("x"))).withColumn("by", F.explode(span("y")))
    return bins.withColumn("bx", F.when(F.col("chart") == "e", F.pmod(F.col("bx"), F.lit(round(360 / step)))).otherwise(F.col("bx"))).distinct()


def _charted_places(obs: DataFrame, key: str, step: float) -> DataFrame:
    chart = F.when(F.col("lat") > CAP, "n").when(F.col("lat") < -CAP, "s").otherwise("e")
    x, y = _polar(F.col("lon"), F.col("lat"))
    flat = chart == "e"
    places = obs.where("lon is not null and lat is not null").select(key, "lon", "lat", chart.alias("chart"), F.when(flat, F.pmod("lon", F.lit(360.0))).otherwise(x).alias("px"), F.when(flat, F.col("lat")).otherwise(y).alias("py"))
    return places.withColumn("bx", F.floor(F.col("px") / step)).withColumn("by", F.floor(F.col("py") / step))


def _cross(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def _inverted(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a and b, the place of (px, py) along and across its cell; only those within it."""
    p = pairs.withColumn("px", F.when(F.col("chart") == "e", F.col("x0") + _turn(F.col("px") - F.col("x0"))).otherwise(F.col("px")))
    side = lambda c: (F.col(f"x{c}") - F.col("x0"), F.col(f"y{c}") - F.col("y0"))
    e, f, far = side(1), side(2), side(3)
    g = (far[0] - e[0] - f[0], far[1] - e[1] - f[1])
    h = (F.col("px") - F.col("x0"), F.col("py") - F.col("y0"))
    p = p.withColumns({"_a2": _cross(g, f), "_a1": _cross(h, g) + _cross(e, f), "_a0": _cross(h, e)})
    root = F.sqrt(F.greatest(F.col("_a1") ** 2 - 4 * F.col("_a2") * F.col("_a0"), F.lit(0.0)))
    p = p.withColumn("_q", -(F.col("_a1") + F.when(F.col("_a1") < 0, -root).otherwise(root)) / 2)
    # Both roots; the second of a parallelogram is none.
    first, second = F.try_divide(F.col("_a0"), F.col("_q")), F.try_divide(F.col("_q"), F.col("_a2"))
    p = p.withColumn("b", F.explode(F.array(first, second))).where((F.col("b") >= -SLACK) & (F.col("b") <= 1 + SLACK))
    along = (e[0] + F.col("b") * g[0], e[1] + F.col("b") * g[1])
    left = (h[0] - F.col("b") * f[0], h[1] - F.col("b") * f[1])
    a = F.try_divide(left[0] * along[0] + left[1] * along[1], along[0] ** 2 + along[1] ** 2)
    return p.withColumn("a", a).where((F.col("a") >= -SLACK) & (F.col("a") <= 1 + SLACK))


def _inverse_squares(distances: list[Column]) -> list[Column]:
    """Weights by inverse squares of distances; a distance of 0 takes all."""
    products = []
    for k in range(len(distances)):
        product = F.lit(1.0)
        for m, d in enumerate(distances):
            if m != k:
                product = product * d * d
        products.append(product)
    total = sum(products[1:], products[0])
    return [F.try_divide(x, total) for x in products]


def quadrilateral_index(obs: DataFrame, grid: DataFrame, nlon: int, nlat: int, periodic: bool = True, fold: bool = False, weights: str = "bilinear", step: float = 2.0, key: str = "obs_id") -> DataFrame:
    """``obs`` with ri and rj on a curvilinear ``grid`` (i, j, lon, lat), null where no cell holds the place.

    ``weights`` is bilinear, the inverse of the cell's own mapping, or distance: the
    mean of the corners' indexes by inverse squares of great-circle distances.
    ``step`` is about a cell's size in degrees and must go into 360. An index beyond
    nlon lies between the last node and the first. ``key`` names rows of ``obs``.
    """
    if weights not in ("bilinear", "distance"):
        raise ValueError("weights are bilinear or distance")
    if abs(360 / step - round(360 / step)) > 1e-9:
        raise ValueError("the step goes into 360")
    quads = _charted_cells(cells(grid, nlon, nlat, periodic, fold), step)
    pairs = _charted_places(obs, key, step).join(quads, ["chart", "bx", "by"])
    found = _inverted(pairs)
    if weights == "distance":
        parts = _inverse_squares([distance("great_circle", F.col("lon"), F.col("lat"), F.col(f"lon{c}"), F.col(f"lat{c}")) for c in _CORNERS])
        place = F.struct("cj", "ci", (F.col("ci") + parts[1] + parts[3]).alias("ri"), (F.col("cj") + parts[2] + parts[3]).alias("rj"))
    else:
        held = lambda x: F.least(F.greatest(F.col(x), F.lit(0.0)), F.lit(1.0))
        place = F.struct("cj", "ci", (F.col("ci") + held("a")).alias("ri"), (F.col("cj") + held("b")).alias("rj"))
    best = found.groupBy(key).agg(F.min(place).alias("_p")).select(key, "_p.ri", "_p.rj")
    return obs.drop("ri", "rj").join(best, key, "left")


def nearest_four_index(obs: DataFrame, grid: DataFrame, nlon: int, reach: float = 2.0e6, key: str = "obs_id") -> DataFrame:
    """``obs`` with ri and rj: the mean of the four nearest nodes' indexes by inverse squares of distances; null with fewer than four in ``reach``.

    i is periodic: indexes count the short way from the nearest node on.
    """
    node = (F.col("j").cast("long") - 1) * nlon + F.col("i") - 1
    near = nearest(obs, grid.withColumn("_n", node), reach, key=key, cell="_n", k=4, metric="great_circle")
    four = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "_n"))).alias("_f")).where(F.size("_f") == 4)
    parts = _inverse_squares([F.col("_f")[k]["dist"] for k in range(4)])
    i = [F.col("_f")[k]["_n"] % nlon + 1 for k in range(4)]
    j = [F.floor(F.col("_f")[k]["_n"] / nlon) + 1 for k in range(4)]
    half = nlon / 2
    shift = lambda k: F.pmod(i[k] - i[0] + half, F.lit(float(nlon))) - half
    ri = i[0] + sum((parts[k] * shift(k) for k in range(1, 4)), F.lit(0.0))
    rj = sum((parts[k] * j[k] for k in range(1, 4)), parts[0] * j[0])
    return obs.drop("ri", "rj").join(four.select(key, ri.alias("ri"), rj.alias("rj")), key, "left")


def regular_index(targets: DataFrame, first_lon: float, lon_step: float, nlon: int, first_lat: float, lat_step: float) -> DataFrame:
    """``targets`` (lon, lat) with ri and rj on a regular grid that goes around the globe; ri is up to nlon + 1."""
    if abs(nlon * lon_step - 360) > 1e-6:
        raise ValueError("the grid goes around the globe")
    return targets.withColumns({"ri": F.pmod(F.col("lon") - first_lon, F.lit(360.0)) / lon_step + 1, "rj": (F.col("lat") - first_lat) / lat_step + 1})


def to_curvilinear(field: DataFrame, targets: DataFrame, first_lon: float, lon_step: float, nlon: int, first_lat: float, lat_step: float, nlat: int, key: str = "cell") -> DataFrame:
    """key and hx: ``field`` (i, j, value), a regular grid around the globe, at the nodes of a curvilinear one (key, lon, lat), as at the tripolar cap of an ocean grid.

    Bilinear; beyond the last row the mean of that row, below the first one nothing.
    """
    placed = regular_index(targets.select(key, "lon", "lat"), first_lon, lon_step, nlon, first_lat, lat_step).where(F.col("rj") >= 1)
    found = bilinear_polar(placed, field, nlon, nlat, key)
    return targets.select(key).join(found, key, "left")
