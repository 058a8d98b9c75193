"""Land and bathymetry: levels of water under a cell, and observations too close to land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOCALISATION_COLUMN, OBS_TYPES

#: A layer thinner than this has no water; a weight of a type below this takes it out.
LEAST_THICKNESS, TINY = 1e-3, 2.2250738585072014e-308
#: Limits of states that are masked, and of the range check after it (t, then s).
LEAST_T, LEAST_S, RANGES = -10.0, 3.0, {"t": (-5.0, 32.0), "s": (2.0, 42.0)}


def wet_levels(layers: DataFrame, cell: list[str]) -> DataFrame:
    """cell and kmt of layers (cell, k, h, wet): the deepest level with water, 0 without any."""
    water = (F.col("h") > LEAST_THICKNESS) & (F.col("wet") > 0)
    return layers.groupBy(*cell).agg(F.coalesce(F.max(F.when(water, F.col("k"))), F.lit(0)).cast("int").alias("kmt"))


def land_reason(kmt: Column, rk: Column) -> Column:
    """near_land where the least number of levels is under 1 (a cell that is missing is land), topography where the level lies below the sea floor."""
    return F.when(F.coalesce(kmt, F.lit(0)) < 1, "near_land").when(kmt < rk, "topography")


def nearest_kmt(obs: DataFrame, grid: DataFrame, nlon: int) -> DataFrame:
    """``obs`` (ri, rj) with kmt of the nearest cell: one equi-join with the grid (i, j, kmt). Halves round away from zero."""
    i = F.pmod(F.round("ri").cast("int") - 1, F.lit(nlon)) + 1
    own = obs.withColumn("_i", i).withColumn("_j", F.round("rj").cast("int"))
    cells = grid.select(F.col("i").alias("_i"), F.col("j").alias("_j"), "kmt")
    return own.join(cells, ["_i", "_j"], "left").drop("_i", "_j")


def masked_state(rows: DataFrame, levels: Column) -> DataFrame:
    """``rows`` (t, s, k, olmask) with t and s null where either is out of bounds, below the cell's ``levels`` or masked."""
    keep = (F.col("t") >= LEAST_T) & (F.col("s") >= LEAST_S) & (F.col("k") <= levels) & (F.col("olmask") >= 0.5)
    return rows.withColumns({c: F.when(keep, F.col(c)) for c in ("t", "s")})


def out_of_range(rows: DataFrame) -> DataFrame:
    """How many values of t and of s lie outside of their ranges."""
    outside = lambda c: F.count(F.when((F.col(c) < RANGES[c][0]) | (F.col(c) > RANGES[c][1]), 1))
    return rows.agg(*[outside(c).alias(f"n_{c}") for c in ("t", "s")])


def localised_by_variable(obs: DataFrame, weights: list[float]) -> DataFrame:
    """``obs`` that may act on a variable, by its row of the variable-localisation matrix (weights by LOCALISATION_COLUMN), with var_weight. Unknown types act on none."""
    pairs = [F.lit(x) for name, column in LOCALISATION_COLUMN.items() for x in (OBS_TYPES[name], float(weights[column - 1]))]
    weight = F.create_map(*pairs)[F.col("elem")]
    return obs.withColumn("var_weight", weight).where(F.col("var_weight") >= TINY)


def overlapping(files: DataFrame, first: Column, last: Column) -> DataFrame:
    """The files (start, end) whose range of dates meets the one asked for."""
    return files.where((F.col("start") <= last) & (F.col("end") >= first))
