"""Errors of profile observations from the vertical gradient, with windows over each profile's levels.

A profile is bounded by its levels (tens to thousands); profiles are spread over
tasks by key. Levels of one profile need distinct ``level`` numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least error and the part that follows the gradient, by variable.
ERRORS = {"t": (1.0, 1.5), "s": (0.05, 0.15)}
#: A range of gradients below this counts as none; the error of a level without value.
LEAST_RANGE, MISSING = 5e-5, 999.0


def profile_error(levels: DataFrame, variable: str = "t", profile: str = "profile", level: str = "level", depth: str = "depth", value: str = "value") -> DataFrame:
    """``levels`` with gradient (filled, smoothed, scaled to 0..1) and err.

    Centred differences held at 0 or more; ends and neighbours of nulls have
    none. A level without one takes the next deeper; a level that still has none
    takes 0. Then the mean over itself and up to two deeper levels, up to the
    first level without value. Then a scale from 0 to 1 over the profile.
    """
    base, follow = ERRORS[variable]
    order = Window.partitionBy(profile).orderBy(level)
    whole = Window.partitionBy(profile)
    deeper = order.rowsBetween(1, Window.unboundedFollowing)
    v, z = F.col(value), F.col(depth)
    df = levels.withColumn("_raw", F.when(v.isNotNull(), F.greatest(F.lit(0.0), (F.lag(v).over(order) - F.lead(v).over(order)) / (F.lead(z).over(order) - F.lag(z).over(order)))))
    # greatest() skips nulls: a missing difference must stay missing.
    df = df.withColumn("_raw", F.when(F.lag(v).over(order).isNotNull() & F.lead(v).over(order).isNotNull(), F.col("_raw")))
    df = df.withColumn("_fill", F.when(v.isNotNull(), F.coalesce("_raw", F.first("_raw", ignorenulls=True).over(deeper), F.lit(0.0))))
    one, two = F.lead("_fill", 1).over(order), F.lead("_fill", 2).over(order)
    smooth = F.when(one.isNull(), F.col("_fill")).when(two.isNull(), (F.col("_fill") + one) / 2.0).otherwise((F.col("_fill") + one + two) / 3.0)
    df = df.withColumn("_smooth", F.when(v.isNotNull(), smooth))
    low, high = F.min("_smooth").over(whole), F.max("_smooth").over(whole)
    df = df.withColumn("gradient", F.when(high - low < LEAST_RANGE, F.when(v.isNotNull(), 0.0)).otherwise((F.col("_smooth") - low) / (high - low)))
    return df.withColumn("err", F.when(v.isNull(), MISSING).otherwise(base + follow * F.col("gradient"))).drop("_raw", "_fill", "_smooth")


def number_profiles(records: DataFrame, order: str, within: str) -> DataFrame:
    """``records`` with profile: a new one starts where both lon and lat differ from the record before, in each ``within`` (a file)."""
    by = Window.partitionBy(within).orderBy(order)
    starts = F.coalesce((F.col("lon") != F.lag("lon").over(by)) & (F.col("lat") != F.lag("lat").over(by)), F.lit(True))
    return records.withColumn("_s", starts.cast("long")).withColumn("profile", F.sum("_s").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
