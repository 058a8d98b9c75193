"""Interpolation to observations: brackets, corners and layers, as equi-joins and weighted sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def intervals(axis: DataFrame, index: str, value: str, by: list[str] | None = None) -> DataFrame:
    """One row per interval of neighbouring axis values: by, index, low, high. An axis is a grid's: thousands of values."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(value)
    return axis.select(*(by or []), index, F.col(value).alias("low"), F.lead(value).over(order).alias("high")).where("high is not null")


def bracket(obs: DataFrame, value: str, axis: DataFrame, index: str, axis_value: str, step: float, name: str) -> DataFrame:
    """``obs`` with the fractional index ``name`` on an axis, by a range join in bins of ``step``.

    low <= value < high; rows outside the axis have null. ``step`` is about the axis' spacing.
    """
    spans = intervals(axis, index, axis_value)
    binned = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor(F.col("high") / step)))).withColumnsRenamed({"low": "_low", "high": "_high", index: "_index"})
    o = obs.withColumn("_obin", F.floor(F.col(value) / step))
    hit = (F.col("_obin") == F.col("_bin")) & (F.col(value) >= F.col("_low")) & (F.col(value) < F.col("_high"))
    fraction = F.col("_index") + (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return o.join(binned, hit, "left").withColumn(name, fraction).drop("_obin", "_bin", "_low", "_high", "_index")


def corners(ri: Column, rj: Column, nlon: int) -> Column:
    """array of struct(i, j, w): the four cells around a fractional index; i wraps past ``nlon``."""
    i, j = F.floor(ri).cast("int"), F.floor(rj).cast("int")
    a, b = ri - F.floor(ri), rj - F.floor(rj)
    east = F.when(i >= nlon, i - nlon + 1).otherwise(i + 1)
    cell = lambda x, y, w: F.struct(x.alias("i"), y.alias("j"), w.alias("w"))
    return F.array(cell(i, j, (1 - a) * (1 - b)), cell(east, j, a * (1 - b)), cell(i, j + 1, (1 - a) * b), cell(east, j + 1, a * b))


def bilinear(obs: DataFrame, field: DataFrame, nlon: int, key: str = "obs_id") -> DataFrame:
    """key and hx: the weighted sum over four cells of ``field`` (i, j, value). Null if a cell with weight has no value (a mask of any corner)."""
    at = obs.where("ri is not null and rj is not null").select(key, F.explode(corners(F.col("ri"), F.col("rj"), nlon)).alias("c")).select(key, "c.*").where("w > 0")
    found = at.join(field.select("i", "j", "value"), ["i", "j"], "left")
    whole = F.count("value") == F.count("w")
    return found.groupBy(key).agg(F.when(whole, F.sum(F.col("w") * F.col("value"))).alias("hx"))


def trilinear(obs: DataFrame, field: DataFrame, nlon: int, key: str = "obs_id") -> DataFrame:
    """As ``bilinear`` with levels: ``obs`` has rk, ``field`` has k."""
    k = F.floor("rk").cast("int")
    c = F.col("rk") - F.floor("rk")
    two = F.array(F.struct(k.alias("k"), (1 - c).alias("wk")), F.struct((k + 1).alias("k"), c.alias("wk")))
    at = obs.where("ri is not null and rj is not null and rk is not null").select(key, F.explode(corners(F.col("ri"), F.col("rj"), nlon)).alias("c"), two.alias("two"))
    at = at.select(key, "c.*", F.explode("two").alias("v")).select(key, "i", "j", "v.k", (F.col("w") * F.col("v.wk")).alias("w")).where("w > 0")
    found = at.join(field.select("i", "j", "k", "value"), ["i", "j", "k"], "left")
    whole = F.count("value") == F.count("w")
    return found.groupBy(key).agg(F.when(whole, F.sum(F.col("w") * F.col("value"))).alias("hx"))


def slab_mean(layers: DataFrame, targets: DataFrame, column: str, half: float) -> DataFrame:
    """For layers (column, top, bottom, value) and targets (column, z): value is the mean over z - half .. z + half, each layer by its overlap."""
    pairs = targets.join(layers, column).withColumn("_w", F.greatest(F.lit(0.0), F.least(F.col("bottom"), F.col("z") + half) - F.greatest(F.col("top"), F.col("z") - half))).where("_w > 0")
    return pairs.groupBy(column, "z").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))


def regrid(source: DataFrame, weights: DataFrame, cell: str = "cell") -> DataFrame:
    """target and value: the sum of weight times value over a table of weights (source, target, weight)."""
    w = weights.withColumnRenamed("source", cell)
    return source.join(w, cell).groupBy("target").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def fill_from_neighbourhood(field: DataFrame, auxiliary: DataFrame, radius: int, nlon: int) -> DataFrame:
    """``field`` (i, j, value) where cells without any value in (2 radius + 1)^2 cells take the auxiliary value; i is periodic, 1-based."""
    valid = field.where("value is not null").select("i", "j")
    steps = F.expr(f"flatten(transform(sequence(-{radius}, {radius}), a -> transform(sequence(-{radius}, {radius}), b -> struct(a, b))))")
    reached = valid.select("i", "j", F.explode(steps).alias("s")).select((F.pmod(F.col("i") + F.col("s.a") - 1, F.lit(nlon)) + 1).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct().withColumn("_near", F.lit(True))
    out = field.join(reached, ["i", "j"], "left").join(auxiliary.select("i", "j", F.col("value").alias("_aux")), ["i", "j"], "left")
    return out.select("i", "j", F.when(F.col("_near"), F.col("value")).otherwise(F.col("_aux")).alias("value"))


def lanczos(values: Column, cutoff: float, half: int = 10) -> Column:
    """A cyclic low-pass filter of 2 half + 1 points over an array; ``cutoff`` in cycles per step."""
    import math

    weights = [2 * cutoff if n == 0 else math.sin(2 * math.pi * cutoff * n) / (math.pi * n) * math.sin(math.pi * n / half) / (math.pi * n / half) for n in range(-half, half + 1)]
    total = sum(weights)
    taps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w / total).alias("w")) for n, w in zip(range(-half, half + 1), weights)])
    n = F.size(values)
    return F.transform(values, lambda _, i: F.aggregate(taps, F.lit(0.0), lambda s, t: s + t["w"] * F.get(values, F.pmod(i + t["n"], n))))


def akima(knots: DataFrame, targets: DataFrame, column: str) -> DataFrame:
    """``targets`` (column, z) with value, by Akima's spline through the knots (column, x, y); null outside of them or with under three knots.

    Slopes beyond the ends go on as the last two do. Knots of one column are the
    levels of a profile; a target meets the intervals of its own column only.
    """
    order, whole = Window.partitionBy(column).orderBy("x"), Window.partitionBy(column)
    k = knots.select(column, "x", "y", F.row_number().over(order).alias("_m"), F.count("*").over(whole).alias("_n"), ((F.lead("y").over(order) - F.col("y")) / (F.lead("x").over(order) - F.col("x"))).alias("_s")).where("_n >= 3")
    at = lambda m: F.max(F.when(F.col("_m") == m, F.col("_s"))).over(whole)
    k = k.withColumns({"_s1": at(F.lit(1)), "_s2": at(F.lit(2)), "_e1": at(F.col("_n") - 1), "_e2": at(F.col("_n") - 2)})

    def slope(step: int) -> Column:
        """The slope of the interval ``step`` further on; beyond the ends by extension."""
        m = F.col("_m") + step
        inner = F.lag("_s", -step).over(order) if step < 0 else F.lead("_s", step).over(order) if step else F.col("_s")
        low = F.col("_s1") + (1 - m) * (F.col("_s1") - F.col("_s2"))
        high = F.col("_e1") + (m - F.col("_n") + 1) * (F.col("_e1") - F.col("_e2"))
        return F.when(m < 1, low).when(m >= F.col("_n"), high).otherwise(inner)

    left, before, own, after = slope(-1), slope(-2), slope(0), slope(1)
    a, b = F.abs(after - own), F.abs(left - before)
    k = k.withColumn("_t", F.when(a + b == 0, 0.0).otherwise((a * left + b * own) / (a + b)))
    spans = k.select(column, "x", "y", "_s", "_t", F.lead("_t").over(order).alias("_u"), F.lead("x").over(order).alias("_end"), (F.col("_m") == F.col("_n")).alias("_last"))
    hit = spans.join(targets, column).where("z >= x and (z < _end or (_last and z = x))")
    d, dx = F.col("z") - F.col("x"), F.col("_end") - F.col("x")
    curve = F.col("y") + d * F.col("_t") + d * d * (3 * F.col("_s") - 2 * F.col("_t") - F.col("_u")) / dx + d * d * d * (F.col("_t") + F.col("_u") - 2 * F.col("_s")) / dx / dx
    found = hit.select(column, "z", F.when(d == 0, F.col("y")).otherwise(curve).alias("value"))
    return targets.join(found, [column, "z"], "left")


def bilinear_polar(obs: DataFrame, field: DataFrame, nlon: int, nlat: int, key: str = "obs_id") -> DataFrame:
    """key and hx: ``bilinear`` with periodic i; beyond the last row the mean of that row."""
    wrapped = F.pmod(F.col("ri") - 1, F.lit(float(nlon))) + 1
    inside = obs.withColumn("ri", wrapped).where(F.col("rj") <= nlat)
    top = field.where(F.col("j") == nlat).agg(F.avg("value").alias("hx")).withColumn("_one", F.lit(1))
    polar = obs.where(F.col("rj") > nlat).select(key, F.lit(1).alias("_one")).join(F.broadcast(top), "_one", "left").select(key, "hx")
    return bilinear(inside, field, nlon, key).unionByName(polar)


def scaled_and_capped(field: DataFrame, box: tuple[float, float, float, float], scale: float, most: float) -> DataFrame:
    """``field`` (lon, lat, value) times ``scale`` over its largest value strictly inside the box (west, east, south, north), and ``most`` at most."""
    west, east, south, north = box
    inside = (F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north)
    top = field.where(inside).agg(F.max("value").alias("_top")).withColumn("_one", F.lit(1))
    joined = field.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one", "left")
    return joined.withColumn("value", F.least(F.col("value") * scale / F.col("_top"), F.lit(most))).drop("_one", "_top")
