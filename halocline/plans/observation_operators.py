"""Observation operators: from observations and a model field to H(x), quality flag and reason, one plan each.

All share a chain: cheap checks on value and place first, then the masks of land
and sea floor and the interpolation, which one join with the corner cells gives,
then the scaled error and thinning. Rows that fail stay with oqc 0 and the reason.

The field and the grid of a member and slot may be of any size: nothing is
broadcast by hand, and each observation meets its four or eight corner cells only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seawater
from ..operators import masks, quality_control, superob
from ..operators.interpolation import corners
from ..schema import OBS_TYPES


@dataclass(frozen=True)
class Settings:
    """``mask``: 2 asks all cells around for water, 1 the nearest one only, 0 none."""

    nlon: int
    nlat: int
    nlev: int
    mask: int = 2
    remove_north: bool = False
    latitude_band: float = 0.0
    most_departure: float | None = None
    error_scale: float = 1.0
    keep_share: float = 1.0
    #: Added to each error, as altimetry has it.
    least_error: float = 0.0
    zero_model: bool = False


def _levels(obs: DataFrame, three_d: bool) -> DataFrame:
    return obs.withColumn("rk", quality_control.surface_clamp(F.col("rk"))) if three_d else obs.withColumn("rk", F.lit(1.0))


def at_corners(obs: DataFrame, field: DataFrame, grid: DataFrame, nlon: int, three_d: bool, values: list[str], by: list[str]) -> DataFrame:
    """obs_id, least kmt of the cells around, and each of ``values`` of ``field`` (i, j, with levels k, and ``by``) at the place; null if a cell has none."""
    cells = F.filter(corners(F.col("ri"), F.col("rj"), nlon), lambda c: c["w"] > 0)
    at = obs.select("obs_id", *by, "rk", F.explode(cells).alias("c")).select("obs_id", *by, "rk", "c.*")
    keys = [*by, "i", "j"]
    if three_d:
        k, part = F.floor("rk").cast("int"), F.col("rk") - F.floor("rk")
        two = F.filter(F.array(F.struct(k.alias("k"), (1 - part).alias("v")), F.struct((k + 1).alias("k"), part.alias("v"))), lambda x: x["v"] > 0)
        at = at.select("obs_id", *keys, "w", F.explode(two).alias("z")).select("obs_id", *keys, "z.k", (F.col("w") * F.col("z.v")).alias("w"))
        keys.append("k")
    found = at.join(field.select(*keys, *values), keys, "left").join(grid.select("i", "j", "kmt"), ["i", "j"], "left")
    mean = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.col("w") * F.col(c)))
    return found.groupBy("obs_id").agg(F.min(F.coalesce("kmt", F.lit(0))).alias("kmt"), *[mean(c).alias(f"_{c}") for c in values])


def observe(obs: DataFrame, field: DataFrame, grid: DataFrame, s: Settings, three_d: bool, values: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``obs`` (obs_id, elem, lon, lat, lev, dat, err, ri, rj, rk) with ohx, oqc and reason; further ``values`` as _name. ``by``: more columns that obs and field share."""
    values = values or ["value"]
    obs = _levels(obs, three_d)
    checks = quality_control.standard_checks(remove_north=s.remove_north, latitude_band=s.latitude_band)
    checks += quality_control.index_checks(F.col("ri"), F.col("rj"), F.col("rk"), s.nlon, s.nlat, s.nlev)
    checked = obs.withColumn("reason", F.coalesce(quality_control.reject_reason(checks), F.when(F.col("ri").isNull() | F.col("rj").isNull() | F.col("rk").isNull(), "no_index")))
    good = checked.where("reason is null")
    met = at_corners(good, field, grid, s.nlon, three_d, values, by or [])
    if s.mask == 1:
        met = met.drop("kmt").join(masks.nearest_kmt(good.select("obs_id", "ri", "rj"), grid, s.nlon).select("obs_id", "kmt"), "obs_id")
    out = checked.join(met, "obs_id", "left").withColumn("ohx", F.col(f"_{values[0]}"))
    later = [masks.land_reason(F.col("kmt"), F.col("rk"))] if s.mask else []
    later.append(F.when(F.col("ohx").isNull(), "no_model"))
    if s.zero_model:
        later.append(F.when((F.abs("ohx") < 1e-12) & (F.col("dat") > 0.1), "zero_model"))
    if s.most_departure is not None:
        later.append(F.when(F.abs(F.col("dat") - F.col("ohx")) > s.most_departure, "departure"))
    if s.keep_share < 1.0:
        draw = F.pmod(F.xxhash64(F.lit(0), "obs_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        later.append(F.when(draw > s.keep_share, "thinned"))
    out = out.withColumn("reason", F.coalesce("reason", *later))
    ok = F.col("reason").isNull()
    out = out.withColumns({"oqc": F.when(ok, 1).otherwise(0), "ohx": F.when(ok, F.col("ohx")), "err": F.when(ok, F.col("err") * s.error_scale).otherwise(F.col("err"))})
    return out.drop("kmt", *(["_value"] if values == ["value"] else []))


def temperature_profiles(obs: DataFrame, state: DataFrame, grid: DataFrame, s: Settings, convert: str = "none") -> DataFrame:
    """H(x) of temperature. ``state`` has t and s by i, j, k; ``convert``: model potential temperature to in-situ (model), or values to potential temperature by their salinity ``sdat`` (obs), or none."""
    out = observe(obs, state, grid, s, True, ["t", "s"])
    pressure = seawater.pressure_from_depth(F.col("lev"), F.col("lat"))
    ok = F.col("oqc") == 1
    if convert == "model":
        out = out.withColumn("ohx", F.when(ok, seawater.in_situ_temperature(F.col("_s"), F.col("_t"), pressure)))
    elif convert == "obs":
        out = out.withColumn("dat", F.when(ok, seawater.potential_temperature(F.col("sdat"), F.col("dat"), pressure, F.lit(0.0))).otherwise(F.col("dat")))
    elif convert != "none":
        raise ValueError("convert is none, model or obs")
    return out.drop("_t", "_s")


def salinity_profiles(obs: DataFrame, field: DataFrame, grid: DataFrame, s: Settings) -> DataFrame:
    return observe(obs, field, grid, s, True)


def sea_level(obs: DataFrame, field: DataFrame, grid: DataFrame, s: Settings, gridded_error: DataFrame | None = None, absolute: bool = True) -> DataFrame:
    """H(x) of sea level. Errors grow by the least error; ``gridded_error`` (i, j, value) of the nearest cell replaces one where it is positive. Absolute heights lose the mean departure of the accepted rows."""
    own = obs.withColumn("err", F.col("err") + s.least_error)
    if gridded_error is not None:
        i = F.pmod(F.round("ri").cast("int") - 1, F.lit(s.nlon)) + 1
        near = gridded_error.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias("_e"))
        own = own.withColumns({"_i": i, "_j": F.round("rj").cast("int")}).join(near, ["_i", "_j"], "left")
        own = own.withColumn("err", F.when(F.col("_e") > 0, F.col("_e")).otherwise(F.col("err"))).drop("_i", "_j", "_e")
    out = observe(own, field, grid, s, False)
    if not absolute:
        return out
    return quality_control.remove_offset(out.withColumn("qc", F.col("oqc")), "ohx").drop("qc")


def surface_temperature(pixels: DataFrame, field: DataFrame, grid: DataFrame, s: Settings, step: float, min_error: float) -> DataFrame:
    """Pixels (lon, lat, dat) to one observation of each wet grid cell with two or more, at the cell's own place, and its H(x): the mean comes first, so few rows are interpolated."""
    i, j = superob.regular_cell(F.col("lon"), F.col("lat"), step)
    cells = superob.superob(pixels.withColumns({"i": i + 1, "j": j + 1}), ["i", "j"], min_error)
    wet = cells.join(grid.where("kmt >= 1").select("i", "j", "lon", "lat"), ["i", "j"])
    own = wet.select(
        ((F.col("j") - 1) * s.nlon + F.col("i")).cast("long").alias("obs_id"), F.lit(OBS_TYPES["sst"]).alias("elem"), "lon", "lat", F.lit(0.0).alias("lev"), "dat", "err",
        F.col("i").cast("double").alias("ri"), F.col("j").cast("double").alias("rj"), F.lit(1.0).alias("rk"),
    )
    return observe(own, field, grid, s, False)


def supplied(obs: DataFrame, s: Settings) -> DataFrame:
    """Files that bring H(x) along (``hx``): checks of error, departure and place only."""
    checks = [c for c in quality_control.standard_checks(remove_north=s.remove_north, most_departure=s.most_departure, hx=F.col("hx")) if s.zero_model or c[0] != "zero_model"]
    # The departure comes right after the error.
    checks.sort(key=lambda c: {"error": 0, "departure": 1}.get(c[0], 2))
    reason = F.coalesce(quality_control.reject_reason(checks), F.when(F.col("hx").isNull(), "no_model"))
    out = obs.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.withColumns({"oqc": F.when(ok, 1).otherwise(0), "ohx": F.when(ok, F.col("hx")), "err": F.when(ok, F.col("err") * s.error_scale).otherwise(F.col("err"))}).drop("hx")


def dispatched(obs: DataFrame, field3: DataFrame, field2: DataFrame, grid: DataFrame, s: Settings) -> DataFrame:
    """Each type by its own kind of field: temperature, salinity and currents by ``field3`` (elem, i, j, k, value), surface types by ``field2`` (elem, i, j, value)."""
    deep: Column = F.col("elem").isin(*[OBS_TYPES[n] for n in ("t", "s", "u", "v")])
    return observe(obs.where(deep), field3, grid, s, True, by=["elem"]).unionByName(observe(obs.where(~deep), field2, grid, s, False, by=["elem"]))


def obs2(rows: DataFrame) -> DataFrame:
    """The columns of the file layout; rows that failed have H(x) 0."""
    hour = F.col("obhr") if "obhr" in rows.columns else F.lit(0.0)
    return rows.select("elem", "lon", "lat", "lev", "dat", "err", F.coalesce("ohx", F.lit(0.0)).alias("ohx"), "oqc", hour.alias("obhr"))


def reasons(rows: DataFrame) -> DataFrame:
    """How many rows each check took out; accepted ones under that name."""
    return rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
