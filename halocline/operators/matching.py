"""Joins that pair rows of two tables: one to one, by record number, as of a time, and places with cells of a curvilinear grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import nearest


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by ``keys``, which name one row of each; a row without a partner, or with several, is an error when it is read."""
    own, other = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = own.join(other, keys, "full")
    n = F.count("*").over(Window.partitionBy(*keys))
    broken = F.col("_l").isNull() | F.col("_r").isNull() | (n != 1)
    checked = both.withColumn("_broken", broken)
    columns = [c for c in both.columns if c not in ("_l", "_r")]
    # The check is part of a column, so that no later projection drops it.
    guard = F.when(F.col("_broken"), F.raise_error(F.lit("the tables do not match one to one")).cast("string"))
    return checked.where(F.coalesce(guard, F.lit("")) == "").select(*columns)


def by_record(records: DataFrame, innovations: DataFrame, member: int) -> DataFrame:
    """Values and innovations of one member (an array by member, 1-based), matched by record number ``rid``: hxb = value - innovation. Types 1 and 2 are t and s, others go."""
    kind = F.when(F.col("kind") == 1, 3073).when(F.col("kind") == 2, 5521)
    pairs = records.where(F.col("kind").isin(1, 2)).join(innovations.select("rid", F.element_at("innovation", member).alias("_a")), "rid")
    return pairs.withColumn("elem", kind).withColumn("hx", F.col("dat") - F.col("_a")).drop("_a", "kind")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the latest row of ``right`` that has the same key and is not later; nulls where there is none.

    Both are sorted together by key and time, so there is no range join and no
    list of a key's rows. Of equal times the one with the greatest columns counts.
    """
    pad = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, time)]
    ours = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_v"))
    theirs = right.select(key, time, *pad, F.lit(0).alias("_side"), F.struct(*columns).alias("_v"))
    order = Window.partitionBy(key).orderBy(time, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = ours.unionByName(theirs).withColumn("_latest", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return latest.select(*left.columns, *[F.col(f"_latest.{c}").alias(c) for c in columns])


def curvilinear_index(obs: DataFrame, grid: DataFrame, nlon: int, reach: float, key: str = "obs_id") -> DataFrame:
    """``obs`` with fractional indexes ri and rj on a grid (i, j, lon, lat; i periodic): the nearest cell, and a part of the way to the neighbour on the side of the place.

    Longitudes differ by the short way round. Without a neighbour on that side, or a cell in ``reach``, the index is null.
    """
    named = grid.withColumn("_ij", (F.col("j") - 1) * nlon + F.col("i"))
    at = nearest(obs, named, reach, key=key, cell="_ij").select(key, "_ij")
    cell = lambda p: named.select(F.col("_ij").alias(f"_{p}"), F.col("lon").alias(f"_{p}_lon"), F.col("lat").alias(f"_{p}_lat"))
    turn = lambda a: F.pmod(a + 180.0, F.lit(360.0)) - 180.0
    d = obs.join(at, key, "left").join(cell("c"), F.col("_ij") == F.col("_c"), "left")
    i, j = F.pmod(F.col("_ij") - 1, F.lit(nlon)) + 1, F.floor((F.col("_ij") - 1) / nlon) + 1
    d = d.withColumns({"_i": i, "_j": j, "_dx": turn(F.col("lon") - F.col("_c_lon")), "_dy": F.col("lat") - F.col("_c_lat")})
    side_i = F.when(F.col("_dx") >= 0, 1).otherwise(-1)
    side_j = F.when(F.col("_dy") >= 0, 1).otherwise(-1)
    beside = (F.col("_j") - 1) * nlon + F.pmod(F.col("_i") - 1 + side_i, F.lit(nlon)) + 1
    d = d.withColumn("_bi", beside).withColumn("_bj", F.col("_ij") + side_j * nlon)
    d = d.join(cell("x"), F.col("_bi") == F.col("_x"), "left").join(cell("y"), F.col("_bj") == F.col("_y"), "left")
    part = lambda own, step: F.when(own == 0, 0.0).otherwise(F.abs(own) / F.abs(step))
    ri = F.col("_i") + side_i * part(F.col("_dx"), turn(F.col("_x_lon") - F.col("_c_lon")))
    rj = F.col("_j") + side_j * part(F.col("_dy"), F.col("_y_lat") - F.col("_c_lat"))
    return d.select(*[d[c] for c in obs.columns if c not in ("ri", "rj")], ri.alias("ri"), rj.alias("rj"))
