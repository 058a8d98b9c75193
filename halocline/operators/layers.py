"""Layered columns: piecewise constant, linear and parabolic profiles in layers, sampled at depths and averaged over intervals.

A column is one row with two arrays: the depths of its interfaces, from the surface
down, one more than layers, and the layers' means. All columns of a batch with the
same number of layers are worked on together; columns are independent, so there is
no shuffle. ``stacked`` makes such rows of a table of layers.

Linear profiles have the lesser of the slopes to both neighbours, none at an
extremum and in the outer layers, and then close the gaps to their neighbours from
the top down. Parabolic profiles (Colella and Woodward, 1984) have edges of fourth
order, made monotonic; the outer layers are constant and their means are the edges
next to them. Both keep each layer's mean, so averages over intervals keep a
column's integral. Columns of under three layers are constant in each layer.

A layer of no thickness counts as THIN where it is divided by, and adds nothing to an
average. A column without a value in any layer has none at any depth (land). Depths
below the last interface, or above the first, have none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least thickness that is divided by, in metres.
THIN = 1e-6
METHODS = ("constant", "linear", "parabolic")


def stacked(layers: DataFrame, by: list[str], order: str, thickness: Column, value: Column) -> DataFrame:
    """by, interfaces and values of each column of a table with a row for each layer. A column has tens of layers."""
    rows = layers.select(*by, F.struct(F.col(order).alias("o"), thickness.cast("double").alias("d"), value.cast("double").alias("v")).alias("_l"))
    columns = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_l")).alias("_l"))
    # The sums of thicknesses from the top down, with 0 before.
    depth = F.aggregate("_l", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["d"])))
    return columns.select(*by, depth.alias("interfaces"), F.col("_l.v").alias("values"))


def linear_slopes(thick: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Differences of the linear profiles from top to bottom of each layer; columns by layers."""
    n = a.shape[1]
    s = np.zeros_like(a)
    if n < 3:
        return s
    h, step = thick, np.diff(a, axis=1)
    to_upper = 2 * h[:, 1:-1] / (h[:, :-2] + h[:, 1:-1]) * step[:, :-1]
    to_lower = 2 * h[:, 1:-1] / (h[:, 1:-1] + h[:, 2:]) * step[:, 1:]
    s[:, 1:-1] = np.where(to_upper * to_lower > 0, np.sign(to_upper) * np.minimum(abs(to_upper), abs(to_lower)), 0.0)
    # Each layer meets the one above as that is after its own turn.
    for j in range(1, n - 1):
        upper = step[:, j - 1] - (s[:, j] + s[:, j - 1]) / 2
        lower = step[:, j] - (s[:, j + 1] + s[:, j]) / 2
        gap = np.where(upper < 0, -1.0, 1.0) * np.minimum(abs(upper), abs(lower))
        s[:, j] += np.where(s[:, j] != 0, 2 * gap, 0.0)
    return s


def parabola_edges(thick: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower edge values of the parabolic profiles; columns by layers."""
    n = a.shape[1]
    top, bottom = a.copy(), a.copy()
    if n < 3:
        return top, bottom
    h, step = thick, np.diff(a, axis=1)
    two = h[:, :-1] + h[:, 1:]
    # Mean slope of inner layers, limited to twice the steps.
    h0, h1, h2 = h[:, :-2], h[:, 1:-1], h[:, 2:]
    before, after = step[:, :-1], step[:, 1:]
    mean = h1 / (h0 + h1 + h2) * ((2 * h0 + h1) / two[:, 1:] * after + (h1 + 2 * h2) / two[:, :-1] * before)
    slope = np.zeros_like(a)
    slope[:, 1:-1] = np.where(before * after > 0, np.sign(mean) * np.minimum(abs(mean), 2 * np.minimum(abs(before), abs(after))), 0.0)
    # Interfaces with two layers on either side.
    if n > 3:
        d, e, f, g = h[:, :-3], h[:, 1:-2], h[:, 2:-1], h[:, 3:]
        jump = step[:, 1:-1]
        above, below = (d + e) / (2 * e + f), (g + f) / (2 * f + e)
        edge = a[:, 1:-2] + e / (e + f) * jump + (2 * f * e / (e + f) * (above - below) * jump - e * above * slope[:, 2:-1] + f * below * slope[:, 1:-2]) / (d + e + f + g)
        top[:, 2:-1], bottom[:, 1:-2] = edge, edge
    top[:, 1], bottom[:, -2] = a[:, 0], a[:, -1]
    low, high, own = top[:, 1:-1], bottom[:, 1:-1], a[:, 1:-1]
    rise, bend = high - low, 6 * own - 3 * (low + high)
    extreme = before * after <= 0
    new_low = np.where(rise * bend > rise**2, 3 * own - 2 * high, low)
    new_high = np.where(rise * bend < -(rise**2), 3 * own - 2 * low, high)
    top[:, 1:-1], bottom[:, 1:-1] = np.where(extreme, own, new_low), np.where(extreme, own, new_high)
    return top, bottom


def coefficients(interfaces: np.ndarray, values: np.ndarray, method: str) -> np.ndarray:
    """c0, c1, c2 of each layer: the profile is c0 + c1 q + c2 q (1 - q), for q from 0 at the top to 1 at the bottom."""
    thick = np.maximum(np.diff(interfaces, axis=1), THIN)
    zero = np.zeros_like(values)
    if method == "linear":
        s = linear_slopes(thick, values)
        return np.stack((values - s / 2, s, zero), axis=2)
    if method == "parabolic":
        top, bottom = parabola_edges(thick, values)
        return np.stack((top, bottom - top, 6 * values - 3 * (top + bottom)), axis=2)
    return np.stack((values, zero, zero), axis=2)


def _sample(p: np.ndarray, c: np.ndarray, depths: np.ndarray) -> np.ndarray:
    thick = np.maximum(np.diff(p, axis=1), THIN)
    out = np.full((len(p), len(depths)), np.nan)
    rows = np.arange(len(p))
    for k, z in enumerate(depths):
        # At an interface the layer above counts.
        l = (p[:, 1:] < z).sum(axis=1)
        inside = (l < c.shape[1]) & (z >= p[:, 0])
        l = np.minimum(l, c.shape[1] - 1)
        q = (z - p[rows, l]) / thick[rows, l]
        own = c[rows, l]
        out[:, k] = np.where(inside, own[:, 0] + q * (own[:, 1] + own[:, 2] * (1 - q)), np.nan)
    return out


def _integral(p: np.ndarray, c: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Integral of each column from its surface to depth z (by column and target)."""
    thick = np.diff(p, axis=1)
    q = np.clip((z[:, :, None] - p[:, None, :-1]) / np.maximum(thick, THIN)[:, None, :], 0, 1)
    c0, c1, c2 = (c[:, None, :, i] for i in range(3))
    return (thick[:, None, :] * q * (c0 + q * ((c1 + c2) / 2 - q * c2 / 3))).sum(axis=2)


def _average(p: np.ndarray, c: np.ndarray, targets: np.ndarray) -> np.ndarray:
    bottom = p[:, -1:]
    z = np.minimum(targets[None, :], bottom)
    total = _integral(p, c, z)
    thick = np.diff(z, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where(thick >= THIN, np.diff(total, axis=1) / thick, np.nan)
    # A thin interval has the value of the one above.
    for k in range(1, out.shape[1]):
        out[:, k] = np.where((thick[:, k] < THIN), out[:, k - 1], out[:, k])
    out[z[:, :-1] >= bottom] = np.nan
    return out


def _by_column(interfaces: pd.Series, values: pd.Series, method: str, work: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> pd.Series:
    """``work`` on the columns of each number of layers at once; null arrays, other lengths and columns with a gap have no values."""
    out = np.empty(len(values), dtype=object)
    sizes = np.array([len(v) if v is not None and p is not None and len(p) == len(v) + 1 else 0 for p, v in zip(interfaces, values)])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        found = np.full((len(at), size), np.nan)
        if n:
            p, v = (np.stack([np.asarray(x, dtype=float) for x in column.iloc[at]]) for column in (interfaces, values))
            whole = ~(np.isnan(p).any(axis=1) | np.isnan(v).any(axis=1))
            if whole.any():
                found[whole] = work(p[whole], coefficients(p[whole], v[whole], method))
        for i, row in zip(at, found):
            out[i] = [None if x != x else x for x in row.tolist()]
    return pd.Series(out, index=values.index)


def _udf(method: str, targets: list[float], work: Callable, size: int):
    if method not in METHODS:
        raise ValueError(f"the methods are {', '.join(METHODS)}")
    axis = np.array(targets, dtype=float)
    if len(axis) and (np.diff(axis) < 0).any():
        raise ValueError("depths go down")

    def run(interfaces: pd.Series, values: pd.Series) -> pd.Series:
        return _by_column(interfaces, values, method, lambda p, c: work(p, c, axis), size)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def sampled(interfaces: Column | str, values: Column | str, depths: list[float], method: str = "parabolic") -> Column:
    """The profile at each depth; null outside of the column."""
    return _udf(method, depths, _sample, len(depths))(interfaces, values)


def averaged(interfaces: Column | str, values: Column | str, targets: list[float], method: str = "parabolic") -> Column:
    """Means of the profile between neighbouring target interfaces, cut off at the bottom; null for intervals below it, and for thin ones the value of the one above."""
    return _udf(method, targets, _average, len(targets) - 1)(interfaces, values)
