"""Verification and merging of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ensemble

#: Fixed value: a perturbation up to this is none.
EPSILON = 2.220446049250313e-16


def region(lat: Column) -> Column:
    """nh from 20 degrees, sh to -20, tropics between."""
    return F.when(lat >= 20.0, "nh").when(lat <= -20.0, "sh").otherwise("tropics")


def verify(fields: DataFrame, weight: str | None = "weight") -> DataFrame:
    """Weighted spread, bias and rmse of ana against ref in each region and over all (region 'global')."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda x: F.sum(w * x) / F.sum(w)
    error = F.col("ana") - F.col("ref")
    out = fields.withColumn("region", region(F.col("lat"))).rollup("region")
    return out.agg(F.sqrt(mean(F.col("spread") * F.col("spread"))).alias("spread"), mean(error).alias("bias"), F.sqrt(mean(error * error)).alias("rmse"), F.count("*").alias("n")).withColumn("region", F.coalesce("region", F.lit("global")))


def merge_tiles(background: DataFrame, tiles: DataFrame, increment: bool = False) -> DataFrame:
    """background (ij, k, kmt, value) with the tiles' values (ij, k, value): overwritten, or null outside tiles and the difference inside; null below the bottom."""
    t = tiles.select("ij", "k", F.col("value").alias("_tile"))
    value = F.col("_tile") - F.col("value") if increment else F.coalesce("_tile", "value")
    return background.join(t, ["ij", "k"], "left").select("ij", "k", F.when(F.col("k") <= F.col("kmt"), value).alias("value"))


def ocean_tiles(grid: DataFrame) -> DataFrame:
    """Tiles with any ocean."""
    return grid.groupBy("tile").agg(F.max("kmt").alias("deepest")).where("deepest > 0")


def level_ranges(state: DataFrame) -> DataFrame:
    return state.groupBy("k", "var").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def departures(obs: DataFrame) -> DataFrame:
    """Every input observation with hx = dat - dep and its qc."""
    return obs.withColumn("hx_mean", F.col("dat") - F.col("dep"))


def mixed_layer_by_spread(profiles: DataFrame, key: str) -> DataFrame:
    """The level of the largest spread of temperature (ties: the upper), level 1 if there is none; ``profiles`` has key, k, ens."""
    from ..functions.ensemble import variance

    ss = variance(F.col("ens"))
    best = profiles.withColumn("_v", ss).groupBy(key).agg(F.max(F.struct("_v", (-F.col("k")).alias("_k"))).alias("_b"))
    return best.select(key, F.when(F.col("_b._v") > 0, -F.col("_b._k")).otherwise(1).alias("mlev"))


def mixed_layer_by_depth(columns: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """The first level whose next level lies below the depth ``mld``. ``levels`` (k, lev) is one grid's vertical axis."""
    from pyspark.sql.window import Window

    spans = levels.withColumn("_next", F.lead("lev").over(Window.orderBy("k"))).where("_next is not null")
    below = F.array_sort(F.collect_list(F.struct("k", "_next")))
    axis = spans.agg(below.alias("_axis"))
    first = F.try_element_at(F.filter("_axis", lambda s: s["_next"] > F.col("mld")), F.lit(1))["k"]
    return columns.join(F.broadcast(axis)).select(key, first.alias("mlev"))


def diversity(rows: DataFrame, ens: str, by: list[str]) -> DataFrame:
    """by, the largest perturbation, and whether members differ at all."""
    largest = F.max(F.array_max(F.transform(ensemble.perturbations(F.col(ens)), F.abs)))
    return rows.groupBy(*by).agg(largest.alias("largest")).withColumn("diverse", F.coalesce(F.col("largest") > EPSILON, F.lit(False)))


def require_diversity(rows: DataFrame, ens: str) -> None:
    """An error if all members of all rows are the same."""
    found = diversity(rows.withColumn("_all", F.lit(1)), ens, ["_all"]).first()
    if found is not None and not found["diverse"]:
        raise ValueError("all members are identical")


def dump(obs: DataFrame) -> DataFrame:
    """``obs`` as lines of text, with a mark at errors that are not positive."""
    fields = [F.col(c).cast("string") for c in ("elem", "lon", "lat", "lev", "dat", "err")]
    return obs.select(F.concat_ws(" ", *fields, F.when(F.col("err") <= 0, "bad_error")).alias("line"))
