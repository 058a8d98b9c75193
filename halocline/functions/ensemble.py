"""Ensembles as array columns: mean, spread, perturbations, relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import let


def mean(ens: Column) -> Column:
    return let(ens, lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size(e))


def perturbations(ens: Column, centre: Column | None = None) -> Column:
    return let(ens, lambda e: let(mean(e) if centre is None else centre, lambda c: F.transform(e, lambda x: x - c)))


def variance(ens: Column, centre: Column | None = None) -> Column:
    """Sample variance over members."""
    squares = lambda e, c: F.aggregate(e, F.lit(0.0), lambda s, x: s + (x - c) * (x - c))
    return let(ens, lambda e: let(mean(e) if centre is None else centre, lambda c: squares(e, c) / (F.size(e) - 1)))


def spread(ens: Column, centre: Column | None = None) -> Column:
    return F.sqrt(variance(ens, centre))


def rtpp(analysis: Column, background: Column, alpha: float) -> Column:
    """Relaxation of the perturbations to those before the analysis."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha lies in [0, 1]")
    relaxed = lambda xa, xb: F.zip_with(analysis, background, lambda a, b: (a - xa) * (1.0 - alpha) + (b - xb) * alpha + xa)
    return let(mean(analysis), lambda xa: let(mean(background), lambda xb: relaxed(xa, xb)))


def rtps(analysis: Column, background: Column, alpha: float) -> Column:
    """Relaxation of the spread to that before the analysis; only where the analysis shrank a spread that is not zero."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha lies in [0, 1]")
    factor = lambda sa, sb: F.when((sa < sb) & (sa > 0), alpha * (sb - sa) / sa + 1.0).otherwise(1.0)
    by = let(spread(analysis), lambda sa: let(spread(background), lambda sb: factor(sa, sb)))
    return let(mean(analysis), lambda xa: let(by, lambda f: F.transform(analysis, lambda a: (a - xa) * f + xa)))


def additive(analysis: Column, draws: Column, amount: float) -> Column:
    """Adds ``amount`` times the draws less their mean."""
    return let(mean(draws), lambda c: F.zip_with(analysis, draws, lambda a, d: a + (d - c) * amount))


def members_to_array(state: DataFrame, keys: list[str], value: str = "value", member: str = "member", name: str = "ens") -> DataFrame:
    """One row per key with the members' values in the order of their numbers."""
    pairs = F.array_sort(F.collect_list(F.struct(member, value)))
    return state.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(name))


def array_to_members(df: DataFrame, name: str = "ens", member: str = "member", value: str = "value") -> DataFrame:
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.posexplode(name).alias("_m", value)).select(*others, (F.col("_m") + 1).alias(member), value)
