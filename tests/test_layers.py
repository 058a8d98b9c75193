"""Profiles in layers: written out layer by layer, and what they keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import layers

RNG = np.random.default_rng(8)


def _columns(n_columns, n):
    thick = RNG.uniform(0.5, 20, (n_columns, n))
    thick[RNG.random(thick.shape) < 0.1] = 0.0
    return np.concatenate((np.zeros((n_columns, 1)), np.cumsum(thick, axis=1)), axis=1), RNG.normal(10, 3, (n_columns, n))


@pytest.mark.parametrize("method", layers.METHODS)
@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_profiles_keep_means_and_stay_between_neighbours(method, n):
    p, a = _columns(200, n)
    c = layers.coefficients(p, a, method)
    np.testing.assert_allclose(c[:, :, 0] + c[:, :, 1] / 2 + c[:, :, 2] / 6, a, atol=1e-9)
    ends = np.stack((c[:, :, 0], c[:, :, 0] + c[:, :, 1]))
    around = np.concatenate((a[:, :1], a, a[:, -1:]), axis=1)
    low = np.minimum(np.minimum(around[:, :-2], a), around[:, 2:])
    high = np.maximum(np.maximum(around[:, :-2], a), around[:, 2:])
    if method != "linear":
        assert (ends >= low - 1e-9).all() and (ends <= high + 1e-9).all()
    targets = np.array([0.0, 3.0, 3.0, 11.0, 40.0, 400.0])
    means = layers._average(p, c, targets)
    kept = np.nansum(np.where(np.diff(np.minimum(targets, p[:, -1:]), axis=1) >= layers.THIN, means, 0) * np.diff(np.minimum(targets, p[:, -1:]), axis=1), axis=1)
    np.testing.assert_allclose(kept, (a * np.diff(p, axis=1)).sum(axis=1), atol=1e-8)


@pytest.mark.parametrize("method", layers.METHODS)
def test_averages_are_means_of_samples(method):
    p, a = _columns(30, 7)
    c = layers.coefficients(p, a, method)
    for z0, z1 in ((1.0, 2.5), (0.0, 14.0), (7.0, 30.0)):
        fine = np.linspace(z0, z1, 4001)
        mid = (fine[1:] + fine[:-1]) / 2
        own = layers._sample(p, c, mid)
        whole = p[:, -1] >= z1
        np.testing.assert_allclose(own[whole].mean(axis=1), layers._average(p, c, np.array([z0, z1]))[whole, 0], rtol=2e-3)


def test_linear_and_parabolic_profiles_meet_a_line():
    p = np.arange(10.0)[None, :] * 2
    a = (p[:, 1:] + p[:, :-1]) / 2 * 3 + 1
    for method in ("linear", "parabolic"):
        got = layers._sample(p, layers.coefficients(p, a, method), np.array([5.0, 8.3, 11.0]))
        np.testing.assert_allclose(got, [[16.0, 25.9, 34.0]], atol=1e-9)


def _by_layer(h, a):
    """Slopes of one column, a layer at a time."""
    n = len(a)
    s = [0.0] * n
    for j in range(1, n - 1):
        left, right = 2 * h[j] / (h[j - 1] + h[j]) * (a[j] - a[j - 1]), 2 * h[j] / (h[j] + h[j + 1]) * (a[j + 1] - a[j])
        if left * right > 0:
            s[j] = (1 if left > 0 else -1) * min(abs(left), abs(right))
    for j in range(1, n - 1):
        if s[j]:
            up, down = a[j] - a[j - 1] - (s[j] + s[j - 1]) / 2, a[j + 1] - a[j] - (s[j + 1] + s[j]) / 2
            s[j] += 2 * (-1 if up < 0 else 1) * min(abs(up), abs(down))
    return s


def test_slopes_of_each_column_alone():
    p, a = _columns(50, 8)
    h = np.maximum(np.diff(p, axis=1), layers.THIN)
    np.testing.assert_allclose(layers.linear_slopes(h, a), [_by_layer(x.tolist(), y.tolist()) for x, y in zip(h, a)])


def test_rows_of_many_kinds(spark):
    rows = [(1, [0.0, 5.0, 9.0], [1.0, 2.0]), (2, None, [1.0]), (3, [0.0], []), (4, [0.0, 5.0], [3.0]), (5, [0.0, 5.0, 9.0], [None, 2.0]), (6, [0.0, 1.0, 1.0, 8.0, 9.0], [4.0, 9.0, 6.0, 7.0])]
    df = spark.createDataFrame(rows, "id long, p array<double>, v array<double>")
    out = df.select("id", layers.sampled("p", "v", [0.0, 5.0, 5.5, 20.0], "constant").alias("z"), layers.averaged("p", "v", [0.0, 5.0, 5.0, 7.0, 9.0, 12.0], "constant").alias("m"))
    got = {r.id: (r.z, r.m) for r in out.collect()}
    none = [None] * 4
    assert got[1] == ([1.0, 1.0, 2.0, None], [1.0, 1.0, 2.0, 2.0, None])
    assert got[2] == got[3] == got[5] == (none, [None] * 5)
    assert got[4] == ([3.0, 3.0, None, None], [3.0, None, None, None, None])
    assert got[6][0] == [4.0, 6.0, 6.0, None]
    assert df.limit(0).select(layers.sampled("p", "v", [1.0]).alias("z")).count() == 0
    with pytest.raises(ValueError):
        layers.sampled("p", "v", [2.0, 1.0])


def test_stacked_layers(spark):
    df = spark.createDataFrame([(1, 3, 4.0, 30.0), (1, 1, 2.0, 10.0), (1, 2, None, 20.0), (2, 5, 1.0, 7.0)], "c long, k int, d double, v double")
    got = {r.c: (r.interfaces, r["values"]) for r in layers.stacked(df.na.fill(0.0), ["c"], "k", F.col("d"), F.col("v")).collect()}
    assert got == {1: ([0.0, 2.0, 2.0, 6.0], [10.0, 20.0, 30.0]), 2: ([0.0, 1.0], [7.0])}
