"""Quality control of observations: reject reasons, and checks against an ensemble.

Both are column expressions over one row, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ensemble
from ..functions.geo import in_box
from ..functions.steps import evaluated
from ..schema import OBS_TYPES, FilterConfig

#: The enclosed sea that the grids don't resolve (west, east, south, north).
ENCLOSED_SEA = (25.0, 45.0, 40.0, 50.0)


def reject_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, null for an accepted row. A check on a null does not hold."""
    first, *rest = checks
    out = F.when(first[1], first[0])
    for name, check in rest:
        out = out.when(check, name)
    return out


def standard_checks(remove_north: bool = False, latitude_band: float = 0.0, most_departure: float | None = None, hx: Column | None = None) -> list[tuple[str, Column]]:
    """The checks on value, place and departure, in their order."""
    lat, lon, dat, err = F.col("lat"), F.col("lon"), F.col("dat"), F.col("err")
    checks = [("error", err <= 0)]
    if remove_north:
        checks.append(("north", lat > 65.0))
    checks.append(("enclosed_sea", in_box(lon, lat, *ENCLOSED_SEA)))
    if latitude_band > 0:
        checks.append(("latitude_band", F.abs(lat) < latitude_band))
    if hx is not None:
        checks.append(("zero_model", (F.abs(hx) < 1e-12) & (dat > 0.1)))
        if most_departure is not None:
            checks.append(("departure", F.abs(dat - hx) > most_departure))
    return checks


def index_checks(ri: Column, rj: Column, rk: Column, nlon: int, nlat: int, nlev: int) -> list[tuple[str, Column]]:
    """Fractional grid indexes (1-based) that lie outside the grid."""
    return [
        ("x_outside", (F.ceil(ri) < 2) | (F.ceil(ri) > nlon + 1)),
        ("y_outside", (F.ceil(rj) < 2) | (F.ceil(rj) > nlat)),
        ("z_outside", F.ceil(rk) > nlev),
    ]


def surface_clamp(rk: Column) -> Column:
    """A level index at the very surface moves just inside the first layer."""
    return F.when((F.ceil(rk) < 2) & (rk < 1.00001), 1.00001).otherwise(rk)


def thinned(obs: DataFrame, share: float, key: str = "obs_id", seed: int = 0) -> DataFrame:
    """Random thinning that gives the same rows each time: a hash of the key is the draw."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return obs.where(draw <= share)


def bits_clear(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == 0


def within_limits(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ensemble_check(obs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """``obs`` (elem, lat, dat, err, hx, qc_members) with hx_mean, hx_var, dep, pert and the final qc and err.

    qc is 1 if every member's flag is 1 and all checks pass. dep is null where a
    member's flag fails. Adaptive errors grow to sqrt(max(dep^2 - var, 0)) on
    accepted rows. An observation without members has qc 0.
    """
    members_ok = F.coalesce(F.array_min("qc_members") == 1, F.lit(False)) & (F.size("hx") > 0)
    df = obs.withColumn("_ok", members_ok).withColumn("hx_mean", F.when(F.size("hx") > 0, ensemble.mean(F.col("hx"))))
    df = evaluated(df)
    df = df.withColumn("pert", ensemble.perturbations(F.col("hx"), F.col("hx_mean"))).withColumn("hx_var", F.when(F.size("hx") > 1, ensemble.variance(F.col("hx"), F.col("hx_mean"))))
    df = df.withColumn("dep", F.when(F.col("_ok"), F.col("dat") - F.col("hx_mean")))
    elem, limit = F.col("elem"), F.col("err") * config.gross_error
    bad = [F.abs(F.col("lat")) > config.most_latitude, (elem == OBS_TYPES["sst"]) & (F.col("dat") < config.least_sst)]
    bad.append((elem == OBS_TYPES["sss"]) & ((F.col("dat") > config.sss_range[1]) | (F.col("dat") < config.sss_range[0])))
    if config.qc_member_departure:
        bad.append(F.exists("hx", lambda h: F.abs(F.col("dat") - h) > F.col("err") * config.gross_error))
    if config.qc_mean_departure:
        bad.append(F.abs(F.col("dep")) > limit)
    good = F.col("_ok")
    for b in bad:
        good = good & ~F.coalesce(b, F.lit(False))
    df = evaluated(df.withColumn("qc", F.when(good, 1).otherwise(0)))
    if config.adaptive_error:
        grown = F.sqrt(F.greatest(F.col("dep") * F.col("dep") - F.coalesce("hx_var", F.lit(0.0)), F.lit(0.0)))
        df = df.withColumn("err", F.when(F.col("qc") == 1, F.greatest("err", grown)).otherwise(F.col("err")))
    return df.drop("_ok")


def graded_error(dep: Column, err: Column, spread: Column, gross: float) -> tuple[Column, Column]:
    """The alternative check: (qc, err); errors grow between once and twice the threshold, beyond that the row is rejected."""
    ratio = F.abs(dep) / (F.greatest(err, spread) * gross)
    return F.when(ratio > 2.0, 0).otherwise(1), F.when((ratio > 1.0) & (ratio <= 2.0), err * ratio).otherwise(err)


def time_weighted_error(err: Column, slot: Column, centre: int, sigma: float) -> Column:
    """Errors that grow with the distance in time slots."""
    apart = (slot - centre) / F.lit(sigma)
    return err * F.exp(0.25 * apart * apart)


def monitor(obs: DataFrame) -> DataFrame:
    """rmse, bias and n of departures of accepted rows for every type, nulls where none was accepted."""
    dep = F.when(F.col("qc") == 1, F.col("dep"))
    return obs.groupBy("elem").agg(F.sqrt(F.avg(dep * dep)).alias("rmse"), F.avg(dep).alias("bias"), F.count(dep).alias("n"))


def remove_offset(obs: DataFrame, hx: str = "hx") -> DataFrame:
    """Values less the mean of value - H(x) over accepted rows: one aggregate, whose row joins back by a constant key."""
    offset = obs.where(F.col("qc") == 1).agg(F.avg(F.col("dat") - F.col(hx)).alias("_offset")).withColumn("_one", F.lit(1))
    joined = obs.withColumn("_one", F.lit(1)).join(F.broadcast(offset), "_one", "left")
    return joined.withColumn("dat", F.col("dat") - F.coalesce("_offset", F.lit(0.0))).drop("_one", "_offset")
