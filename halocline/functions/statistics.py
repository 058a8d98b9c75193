"""Vector statistics as aggregates, with the divisors that the file formats' tools use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def anomaly_correlation(x: Column, y: Column, clim: Column) -> Column:
    """Correlation of departures from a climatology, about zero."""
    a, b = x - clim, y - clim
    return F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))


def vector_statistics(x: Column, y: Column, clim: Column) -> list[Column]:
    return [
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("stdev"),
        F.covar_samp(x, y).alias("covar"),
        F.corr(x, y).alias("correl"),
        anomaly_correlation(x, y, clim).alias("anomcorrel"),
        l2_norm(x).alias("l2norm"),
        rms(x).alias("rms"),
    ]
