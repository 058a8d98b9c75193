"""Distance joins on the sphere as equi-joins of cubes.

Space is cut into cubes with a side of the largest radius; two places within that
radius lie in the same or in touching cubes, by chord and so also by arc. The
side without payload is written to its 27 cubes, joined on the cube, and an exact
distance filter follows. No pair occurs twice, poles and the date line need no
care, and a crowded cube is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import CUT_OFF, basin_mark, distance, horizontal_sigma, localisation_weight, same_basin, unit_xyz


def cube(lon: Column, lat: Column, side: float) -> Column:
    """The cube of a place, as struct(x, y, z)."""
    return F.struct(*[F.floor(c / F.lit(side)).cast("int").alias(n) for n, c in zip("xyz", unit_xyz(lon, lat))])


def touching(c: Column) -> Column:
    """The cube and its 26 neighbours."""
    steps = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(d).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for d in (-1, 0, 1)])
    return F.transform(steps, lambda s: F.struct((c["x"] + s["x"]).alias("x"), (c["y"] + s["y"]).alias("y"), (c["z"] + s["z"]).alias("z")))


def reached(df: DataFrame, name: str, side: float, radius: float) -> DataFrame:
    """``df`` (lon, lat) with a row for each cube of this side that reaches within ``radius`` of its place, by chord, and that cube."""
    for axis, x in zip("xyz", unit_xyz(F.col("lon"), F.col("lat"))):
        # A metre more for rounding.
        low, high = (F.floor((x + F.lit(by)) / F.lit(side)).cast("int") for by in (-radius - 1.0, radius + 1.0))
        df = df.withColumn(f"_{axis}", F.explode(F.sequence(low, high)))
    return df.withColumn(name, F.struct(*[F.col(f"_{axis}").alias(axis) for axis in "xyz"])).drop("_x", "_y", "_z")


def within(points: DataFrame, obs: DataFrame, radius: float, metric: str = "chord") -> DataFrame:
    """Pairs of all rows of both at most ``radius`` metres apart, with dist.

    ``points`` has lon and lat; those of ``obs`` are returned as obs_lon and
    obs_lat. Other columns must have distinct names. Null places have no pair.
    """
    p = points.where("lon is not null and lat is not null").withColumn("_c", F.explode(touching(cube(F.col("lon"), F.col("lat"), radius))))
    o = obs.where("lon is not null and lat is not null").withColumnsRenamed({"lon": "obs_lon", "lat": "obs_lat"}).withColumn("_c", cube(F.col("obs_lon"), F.col("obs_lat"), radius))
    dist = distance(metric, F.col("lon"), F.col("lat"), F.col("obs_lon"), F.col("obs_lat"))
    return p.join(o, "_c").drop("_c").withColumn("dist", dist).where(F.col("dist") <= radius)


def localised(points: DataFrame, obs: DataFrame, sigma_equator: float, sigma_pole: float, metric: str = "chord", block_basins: bool = False) -> DataFrame:
    """Pairs within the cut-off of each point's own radius, with dist and weight."""
    radius = CUT_OFF * max(sigma_equator, sigma_pole)
    sigma = horizontal_sigma(F.col("lat"), sigma_equator, sigma_pole)
    pairs = within(points, obs, radius, metric).where(F.col("dist") <= CUT_OFF * sigma)
    if block_basins:
        pairs = pairs.where(same_basin(basin_mark(F.col("lon"), F.col("lat")), basin_mark(F.col("obs_lon"), F.col("obs_lat"))))
    return pairs.withColumn("weight", localisation_weight(F.col("dist"), sigma))


def nearest(obs: DataFrame, grid: DataFrame, reach: float, key: str = "obs_id", cell: str = "ij", k: int = 1, metric: str = "chord") -> DataFrame:
    """The ``k`` nearest grid cells within ``reach`` of every observation: key, cell, dist and rank; of cells that are as near to a millimetre the least comes first.

    ``reach`` is the largest distance that may occur, which follows from the
    grid's spacing; an observation with fewer cells in reach has fewer rows.
    """
    pairs = within(obs.select(key, "lon", "lat"), grid.select(cell, "lon", "lat"), reach, metric)
    if k == 1:
        best = pairs.groupBy(key).agg(F.min(F.struct(F.round("dist", 3).alias("_d"), cell, "dist")).alias("_b"))
        return best.select(key, F.col(f"_b.{cell}").alias(cell), F.col("_b.dist").alias("dist"), F.lit(1).alias("rank"))
    # A filter on row_number is a limit in each group before the shuffle as well.
    order = Window.partitionBy(key).orderBy(F.round("dist", 3), cell)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, cell, "dist", "rank")
