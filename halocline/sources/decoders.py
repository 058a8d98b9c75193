"""Rules that turn satellite and profile tables into observations: masks, flags, quality and errors, as column expressions.

Raw tables hold one row per pixel or per profile (levels in arrays); packed
integers are unpacked by scale and offset, fill values become null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import EPOCHS, from_epoch_seconds, in_window
from ..schema import KELVIN, OBS_TYPES

#: Bits of the swath flag word that reject a pixel (1, 2, 8, 10 to 13, and the two-bit field at 14).
SWATH_BITS = (1 << 1) | (1 << 2) | (1 << 8) | (1 << 10) | (1 << 11) | (1 << 12) | (1 << 13) | (3 << 14)
#: Bits 0 to 9 of the salinity flag word, the least and largest error kept.
SALINITY_BITS, SALINITY_ERRORS = (1 << 10) - 1, (0.2, 2.0)
LEAST_FRACTION = 0.001


def unpack(raw: Column, fill: int, scale: float, offset: float) -> Column:
    return F.when(raw != fill, raw.cast("double") * scale + offset)


def kelvin_to_celsius(x: Column) -> Column:
    return x - KELVIN


def swath_sst(pixels: DataFrame, least_quality: int = 5, centre: Column | None = None, seconds: float | None = None) -> DataFrame:
    """Pixels (lon, lat, sst in kelvin, err, flags, quality, time) to observations of sst; rejects by flags, quality, nulls and time."""
    keep = (F.col("flags").bitwiseAND(F.lit(SWATH_BITS)) == 0) & (F.col("quality") >= least_quality) & F.col("sst").isNotNull() & F.col("err").isNotNull()
    if centre is not None and seconds is not None:
        keep = keep & (F.abs(F.timestamp_diff("MICROSECOND", centre, F.col("time"))) <= F.lit(int(seconds * 1e6)))
    return pixels.where(keep).select(F.lit(OBS_TYPES["sst"]).alias("elem"), "lon", "lat", F.lit(0.0).alias("lev"), kelvin_to_celsius(F.col("sst")).alias("dat"), "err")


def swath_salinity(pixels: DataFrame, keep_columns: Sequence[str] = (), sss_range: tuple[float, float] | None = None, err_range: tuple[float, float] | None = None, fill: float | None = None) -> DataFrame:
    """Pixels (lon, lat, sss, err, flags): large errors and flags go, small errors grow to the least. ``keep_columns`` stay beside.

    The file's valid ranges, where given, hold for values and errors; a pixel with
    the ``fill`` value, to the nearest whole number, in any of the four goes.
    """
    low, high = SALINITY_ERRORS
    keep = (F.col("flags").bitwiseAND(F.lit(SALINITY_BITS)) == 0) & (F.col("err") <= high) & F.col("sss").isNotNull()
    for column, valid in (("sss", sss_range), ("err", err_range)):
        if valid:
            keep &= F.col(column).between(*valid)
    if fill is not None:
        for column in ("lon", "lat", "sss", "err"):
            keep &= F.round(F.col(column)) != F.lit(float(round(fill)))
    return pixels.where(keep).select(F.lit(OBS_TYPES["sss"]).alias("elem"), "lon", "lat", F.lit(0.0).alias("lev"), F.col("sss").alias("dat"), F.greatest(F.col("err"), F.lit(low)).alias("err"), *keep_columns)


def line_times(lines: DataFrame, epoch: str = EPOCHS["salinity"]) -> DataFrame:
    """swath, line and time of scan lines (swath, line, seconds since ``epoch``), in whole seconds, rounded up.

    A line without a time has one between the nearest lines before and after that do,
    by its number; before the first and after the last of them it has none.
    """
    order = Window.partitionBy("swath").orderBy("line")
    known = F.when(F.col("seconds").isNotNull(), F.struct("line", "seconds"))
    last = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.first(known, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    spans = lines.withColumn("_a", last).withColumn("_b", following)
    part = F.coalesce(F.try_divide(F.col("line") - F.col("_a.line"), F.col("_b.line") - F.col("_a.line")), F.lit(0.0))
    seconds = F.col("_a.seconds") + part * (F.col("_b.seconds") - F.col("_a.seconds"))
    return spans.select("swath", "line", from_epoch_seconds(F.ceil(seconds).cast("double"), epoch).alias("time"))


def timed_swath(pixels: DataFrame, lines: DataFrame, centre: Column, seconds: float) -> DataFrame:
    """``pixels`` (swath, line, ...) with the time of their line, of lines within ``seconds`` of ``centre``: the lines are chosen before they meet the pixels."""
    chosen = line_times(lines).where(in_window(F.col("time"), centre, seconds))
    return pixels.join(chosen, ["swath", "line"])


def gridded_salinity(cells: DataFrame, err: float, keep_columns: Sequence[str] = ()) -> DataFrame:
    """Cells (lon, lat, sss, land, ice): any land or ice goes."""
    keep = (F.col("land") < LEAST_FRACTION) & (F.col("ice") < LEAST_FRACTION) & F.col("sss").isNotNull()
    return cells.where(keep).select(F.lit(OBS_TYPES["sss"]).alias("elem"), "lon", "lat", F.lit(0.0).alias("lev"), F.col("sss").alias("dat"), F.lit(err).alias("err"), *keep_columns)


def profile_levels(profiles: DataFrame, values: str, depths: str) -> DataFrame:
    """One row per level of each profile (arrays) with a usable value: level, depth, value."""
    rows = profiles.select(*[c for c in profiles.columns if c not in (values, depths)], F.posexplode(F.arrays_zip(F.col(values).alias("v"), F.col(depths).alias("d"))).alias("_k", "_p"))
    v, d = F.col("_p.v"), F.col("_p.d")
    # Fill values of profile files.
    keep = (v < 999.0) & (d < 99999.0) & (F.abs(v + 99.0) > 1.0)
    return rows.where(keep).select(*[c for c in rows.columns if not c.startswith("_")], (F.col("_k") + 1).alias("level"), d.alias("depth"), v.alias("value"))


def altimeter(rows: DataFrame, missing: float, keep_columns: Sequence[str] = ()) -> DataFrame:
    """Rows (lon, lat, days, value, err) of a track: hour is the fraction of the day count."""
    return rows.where(F.col("value") < missing).select(F.lit(OBS_TYPES["eta"]).alias("elem"), "lon", "lat", F.lit(0.0).alias("lev"), F.col("value").alias("dat"), "err", ((F.col("days") - F.floor("days")) * 24.0).alias("obhr"), *keep_columns)


def drifter_rows(positions: DataFrame) -> DataFrame:
    """One row for each of x, y, z of a position (drifter, x, y, z, err, obhr)."""
    kinds = F.array(*[F.struct(F.lit(OBS_TYPES[n]).alias("elem"), F.col(n).alias("dat")) for n in ("x", "y", "z")])
    return positions.select(*positions.columns, F.explode(kinds).alias("_e")).select("_e.elem", *positions.columns, "_e.dat")


def merge_members(rows: DataFrame) -> DataFrame:
    """Rows of one file for each (slot, member) to one row per observation: hx and qc_members in the order of members."""
    pairs = F.array_sort(F.collect_list(F.struct("member", "ohx", "oqc")))
    keys = ["slot", "rid", "elem", "lon", "lat", "lev", "dat", "err"]
    return rows.groupBy(*keys).agg(pairs.alias("_m")).select(*keys, F.transform("_m", lambda x: x["ohx"]).alias("hx"), F.transform("_m", lambda x: x["oqc"]).alias("qc_members"))


def align(rows: DataFrame, control: DataFrame, key: str) -> DataFrame:
    """The rows of a member's file that the control file has."""
    return rows.join(control.select(key).distinct(), key, "left_semi")


def flag_quality(rows: DataFrame, counts: str = "quality") -> DataFrame:
    return rows.groupBy(counts).agg(F.count("*").alias("n"))


#: Types of the atmosphere's file format: levels in hectopascals, fractions in per cent, surface pressure.
ATMOSPHERE_LEVELS, HUMIDITY, SURFACE_PRESSURE = (1210, 1211, 1220, 1250, 1251), 1221, 1100
#: Degrees between which a profile message is kept.
MESSAGE_RANGE = (-4.0, 50.0)


def pascals(rows: DataFrame) -> DataFrame:
    """Rows (elem, lev, dat, err) of the atmosphere in pascals and fractions; others as they are."""
    kind = F.col("elem")
    factor = F.when(kind == HUMIDITY, 0.01).when(kind == SURFACE_PRESSURE, 100.0).otherwise(1.0)
    lev = F.when(kind.isin(*ATMOSPHERE_LEVELS, HUMIDITY), F.col("lev") * 100.0).otherwise(F.col("lev"))
    return rows.withColumns({"lev": lev, "dat": F.col("dat") * factor, "err": F.col("err") * factor})


def message_levels(rows: DataFrame) -> DataFrame:
    """Levels of profile messages (kelvin, hour, minute) with dat in Celsius and the hour as a fraction; values out of range go."""
    low, high = MESSAGE_RANGE
    out = rows.withColumns({"dat": kelvin_to_celsius(F.col("kelvin")), "obhr": F.col("hour") + F.col("minute") / 60.0})
    return out.where((F.col("dat") > low) & (F.col("dat") < high)).drop("kelvin", "hour", "minute")


def feedback_levels(profiles: DataFrame, default_error: float | None = None) -> DataFrame:
    """Profiles with arrays of values, model, depths and errors to a row per level: dat, hx, lev and err, of which missing ones become ``default_error``."""
    arrays = F.arrays_zip(F.col("values").alias("dat"), F.col("model").alias("hx"), F.col("depths").alias("lev"), F.col("errors").alias("err"))
    others = [c for c in profiles.columns if c not in ("values", "model", "depths", "errors")]
    rows = profiles.select(*others, F.posexplode(arrays).alias("_k", "_p")).select(*others, (F.col("_k") + 1).alias("level"), "_p.*").where("dat is not null")
    return rows if default_error is None else rows.withColumn("err", F.coalesce("err", F.lit(default_error)))


def geostationary(pixels: DataFrame, navigation: DataFrame | None, least_quality: int) -> DataFrame:
    """Pixels (pixel, sst in kelvin, quality) of good quality to observations of sst; places come from ``navigation`` (pixel, lon, lat) where the file has none."""
    good = pixels.where((F.col("quality") >= least_quality) & F.col("sst").isNotNull())
    placed = good if navigation is None else good.join(navigation.select("pixel", "lon", "lat"), "pixel", "left").where("lon is not null and lat is not null")
    return placed.withColumns({"elem": F.lit(OBS_TYPES["sst"]), "dat": kelvin_to_celsius(F.col("sst"))}).drop("sst", "quality")


def pathfinder(pixels: DataFrame, least_quality: int, ice: bool = False) -> DataFrame:
    """Pixels (lon, lat, sst in kelvin, ice, quality): sst, or the ice fraction, of those of the quality asked for."""
    good = pixels.where(F.col("quality") >= least_quality)
    value = F.col("ice") if ice else kelvin_to_celsius(F.col("sst"))
    return good.withColumns({"elem": F.lit(OBS_TYPES["sic" if ice else "sst"]), "dat": value}).drop("sst", "ice", "quality")


def ice_lines(lines: DataFrame, nlat: int, most: float = 100.0) -> DataFrame:
    """Lines (line, cells of i and percent) of a raster written north first: i, j from the south, dat as a fraction; values out of 0 to ``most`` go."""
    cells = lines.select("line", F.explode("cells").alias("c")).where((F.col("c.percent") >= 0) & (F.col("c.percent") <= most))
    return cells.select("c.i", (nlat + 1 - F.col("line")).alias("j"), (F.col("c.percent") / most).alias("dat"))
