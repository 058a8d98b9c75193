"""Super-observations: one observation per grid cell, by a hash aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def superob(obs: DataFrame, cell: list[str], min_error: float, scale: float = 1.0, single_error: float | None = None, constant_error: float | None = None) -> DataFrame:
    """cell, n, dat (mean) and err = scale * (min_error + sample standard deviation).

    Cells of one observation go unless ``single_error`` is given: they then have
    min_error + single_error. ``constant_error`` replaces all errors.
    """
    out = obs.groupBy(*cell).agg(F.count("dat").alias("n"), F.avg("dat").alias("dat"), F.stddev_samp("dat").alias("_sd"))
    out = out.where("n >= 1" if single_error is not None else "n > 1")
    err: Column = scale * (F.lit(min_error) + F.col("_sd"))
    if single_error is not None:
        err = F.when(F.col("n") > 1, err).otherwise(min_error + single_error)
    if constant_error is not None:
        err = F.lit(constant_error)
    return out.select(*cell, "n", "dat", err.alias("err"))


def regular_cell(lon: Column, lat: Column, step: float) -> tuple[Column, Column]:
    """0-based cell of a regular grid whose first edges are 0E and 90S."""
    return F.floor(F.pmod(lon, F.lit(360.0)) / step).cast("int"), F.floor((lat + 90.0) / step).cast("int")


def cell_centre(i: Column, j: Column, step: float) -> tuple[Column, Column]:
    return (i + 0.5) * step, (j + 0.5) * step - 90.0
