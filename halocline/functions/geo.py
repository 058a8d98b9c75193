"""Geometry on the sphere, localisation weights and basins, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import EARTH_RADIUS, PI


def _radians(degrees: Column) -> Column:
    return degrees * F.lit(PI / 180.0)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along the sphere; the cosine is held within [-1, 1]."""
    cosine = F.sin(_radians(lat1)) * F.sin(_radians(lat2)) + F.cos(_radians(lat1)) * F.cos(_radians(lat2)) * F.cos(_radians(lon2 - lon1))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) * F.lit(EARTH_RADIUS)


def unit_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Metres from the earth's centre."""
    r = F.lit(EARTH_RADIUS)
    return r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), r * F.sin(F.radians(lat))


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres straight through the sphere."""
    a, b = unit_xyz(lon1, lat1), unit_xyz(lon2, lat2)
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b)))


def distance(metric: str, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return {"chord": chord, "great_circle": great_circle}[metric](lon1, lat1, lon2, lat2)


def wrap_longitude(lon: Column) -> Column:
    return F.pmod(lon, F.lit(360.0))


def centre_longitude(lon: Column, err: Column, first: float, last: float, gap: float | None = None) -> tuple[Column, Column]:
    """Longitudes moved into [first, last] and their errors.

    A point in the gap between the grid's ends moves to an end, the near one in
    the half of the gap next to where it came from, and its error doubles. The
    gap is what a full circle lacks unless given.
    """
    gap = 360.0 - (last - first) if gap is None else gap
    over, under = F.abs(lon - F.lit(last)), F.abs(F.lit(first) - lon)
    east, west = lon >= F.lit(last), lon < F.lit(first)
    moved = (
        F.when(east & (over < gap / 2), last)
        .when(east & (over < gap), first)
        .when(east, F.lit(first) + over - gap)
        .when(west & (under < gap / 2), first)
        .when(west & (under < gap), last)
        .when(west, F.lit(last) - under + gap)
        .otherwise(lon)
    )
    return moved, F.when((east & (over < gap)) | (west & (under < gap)), err * 2.0).otherwise(err)


def basin_mark(lon: Column, lat: Column) -> Column:
    """1 Atlantic, 2 Pacific, 0 outside the latitudes where land parts them."""
    x = wrap_longitude(lon)
    # Latitude bands (over, up to) and the longitude west of which a point is Pacific.
    bands = ((-2.0, 8.5, 285.0), (8.5, 15.5, 276.0), (15.5, 19.5, 270.0), (19.5, 32.0, 258.0))
    out = F.lit(0)
    for low, high, edge in bands:
        pacific = (x < edge) & (x > 30.0) if low == -2.0 else x < edge
        out = F.when((lat > low) & (lat <= high), F.when(pacific, 2).otherwise(1)).otherwise(out)
    return out


def same_basin(mark_a: Column, mark_b: Column) -> Column:
    return (mark_a * mark_b) != 2


def horizontal_sigma(lat: Column, equator: float, pole: float) -> Column:
    return (1.0 - F.abs(lat) / 90.0) * (equator - pole) + F.lit(pole)


#: The weight is cut off at this many sigmas.
CUT_OFF = 2.0 * (10.0 / 3.0) ** 0.5


def localisation_weight(dist: Column, sigma: Column, level_distance: Column | None = None, sigma_vertical: float = 1.0) -> Column:
    squares = F.pow(dist / sigma, F.lit(2.0))
    if level_distance is not None:
        squares = squares + F.pow(level_distance / F.lit(sigma_vertical), F.lit(2.0))
    return F.exp(-0.5 * squares)


def level_distance(kind: Column, obs_level: Column, level: Column, mixed_layer: Column | None = None, no_vertical: bool = False) -> Column:
    """Vertical distance by type: ssh none; others the difference of levels; unknown types none.

    With a mixed layer and no vertical localisation, sst reaches every level of
    the mixed layer and none below it.
    """
    apart = F.abs(obs_level - level)
    sst = F.when(level <= mixed_layer, 0.0).otherwise(F.lit(float("inf"))) if mixed_layer is not None and no_vertical else apart
    return F.when(kind == "ssh", 0.0).when(kind == "sst", sst).when(kind.isin("sss", "u", "v", "t", "s"), apart).otherwise(0.0)


def coriolis(lat: Column) -> Column:
    # Fixed value: the earth's rotation in radians a second.
    return F.lit(2 * 7.2921e-5) * F.sin(F.radians(lat))


def in_box(lon: Column, lat: Column, west: float, east: float, south: float, north: float) -> Column:
    """Strictly inside."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def taper_error(err: Column, lat: Column, edge: float, width: float) -> Column:
    """Error variance that grows beyond ``edge`` degrees of latitude, by exp(2 (|lat| - edge) / width)."""
    beyond = F.abs(lat) - edge
    return F.when(beyond > 0, err * F.exp(2.0 * beyond / width)).otherwise(err)


def gaussian_weights(latitudes: DataFrame, lat: str = "lat") -> DataFrame:
    """``weight`` of each latitude row: the difference of the sines of its edges, midway to its neighbours and at the poles.

    The table is one row for each latitude of a grid: a few thousand at most.
    """
    order = Window.orderBy(lat)
    low = F.coalesce((F.col(lat) + F.lag(lat).over(order)) / 2.0, F.lit(-90.0))
    high = F.coalesce((F.col(lat) + F.lead(lat).over(order)) / 2.0, F.lit(90.0))
    return latitudes.withColumn("weight", F.abs(F.sin(F.radians(high)) - F.sin(F.radians(low))))


def grid_index(ij: Column, nlon: int) -> tuple[Column, Column]:
    """1-based (i, j) of a 1-based cell number."""
    return F.pmod(ij - 1, F.lit(nlon)).cast("int") + 1, F.floor((ij - 1) / F.lit(nlon)).cast("int") + 1
