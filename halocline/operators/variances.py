"""Background variances from vertical gradients: columns as arrays from the surface down, wet levels only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import let


def _list(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def gradients(values: Column, depths: list[float]) -> Column:
    """Decrease per metre at each level: the steps to both neighbours by how near their middles are; the outer levels as their neighbours, and zero for a single level.

    ``depths`` go down; a column has as many levels as they or fewer.
    """
    middles = [0.0, *((a + b) / 2 for a, b in zip(depths, depths[1:]))]
    apart = [depths[1] - depths[0], *(b - a for a, b in zip(depths, depths[1:]))]
    # The share of the step above, by level.
    share = [0.5, *((middles[k + 1] - depths[k]) / (middles[k + 1] - middles[k]) for k in range(1, len(depths) - 1)), 0.5]

    def column(v: Column) -> Column:
        n = F.size(v)
        step = lambda k: (F.get(v, k - 1) - F.get(v, k)) / F.get(_list(apart), k)

        def level(k: Column) -> Column:
            inner = F.greatest(F.lit(1), F.least(k, n - 2))
            w = F.get(_list(share), inner)
            return F.when(n >= 3, step(inner) * w + step(inner + 1) * (1 - w)).when(n == 2, step(F.lit(1))).otherwise(0.0)

        return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), level))

    return let(values, column)


def normalised(columns: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    """``columns`` with ``values`` over the largest of all columns of ``by``, none under zero; then the first level as the second. Without a value over zero they stay as they are."""
    top = columns.groupBy(*by).agg(F.max(F.array_max(values)).alias("_top"))
    held = F.transform(values, lambda x: F.greatest(x, F.lit(0.0)) / F.col("_top"))
    scaled = F.when(F.col("_top") > 0, held).otherwise(F.col(values))
    first = F.when(F.size("_v") > 1, F.concat(F.slice("_v", 2, 1), F.slice("_v", 2, F.size("_v")))).otherwise(F.col("_v"))
    return columns.join(top, by).withColumn("_v", scaled).withColumn(values, first).drop("_v", "_top")


def mean_of_levels(values: Column, reach: int) -> Column:
    """Each level as the mean of those at most ``reach`` levels away."""
    def column(v: Column) -> Column:
        return F.transform(v, lambda _, k: let(F.slice(v, F.greatest(k - reach, F.lit(0)) + 1, F.least(k, F.lit(reach)) + reach + 1), lambda own: F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / F.size(own)))

    return let(values, column)


def by_thickness(values: Column, depths: list[float]) -> Column:
    """Values over the thickness of their levels, whose middles ``depths`` are."""
    thick = [2 * depths[0]]
    for a, b in zip(depths, depths[1:]):
        thick.append(2 * (b - a) - thick[-1])
    return F.transform(values, lambda x, k: x / F.get(_list(thick), k))


def roots(values: Column, times: int = 1) -> Column:
    """The square root, ``times`` times; zero for values under it."""
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    for _ in range(times):
        values = F.transform(values, root)
    return values


def tapered(values: Column, depths: list[float], rest: float, squared: bool = False) -> Column:
    """From the level of the largest value down, times what falls in a line from 1 there to ``rest`` at the last of ``depths``."""
    last = float(depths[-1])

    def column(v: Column) -> Column:
        top = F.array_max(v)

        def level(x: Column, k: Column, at: Column) -> Column:
            z, z0 = F.get(_list(depths), k), F.get(_list(depths), at)
            factor = F.coalesce(F.try_divide(last - z + rest * (z - z0), last - z0), F.lit(1.0))
            return F.when(k >= at, x * (factor * factor if squared else factor)).otherwise(x)

        first = F.when(top > 0, F.array_position(v, top).cast("int") - 1).otherwise(0)
        return let(first, lambda at: F.transform(v, lambda x, k: level(x, k, at)))

    return let(values, column)


def surface_within(values: Column, least: float, most: float) -> Column:
    """A surface under ``least`` is lifted to it, with the levels below down to the first that isn't under; one over ``most`` is cut likewise. Without such a level nothing changes."""

    def column(v: Column) -> Column:
        first = lambda good: F.array_position(F.transform(v, good), True).cast("int") - 1
        held = lambda to, bound: F.transform(v, lambda x, k: F.when(k < to, bound).otherwise(x))
        up, down = first(lambda x: x >= least), first(lambda x: x <= most)
        surface = F.get(v, F.lit(0))
        return F.when(surface < least, let(up, lambda to: held(to, least))).when(surface > most, let(down, lambda to: held(to, most))).otherwise(v)

    return let(values, column)
