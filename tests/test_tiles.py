"""Tiles give what the whole raster gives: means, fills from squares, relaxation; and columns of variances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import tiles, variances

RNG = np.random.default_rng(31)
SCHEMA = "raster long, i int, j int, value double"


def _rows(v, raster=1):
    return [(raster, i + 1, j + 1, None if np.isnan(v[j, i]) else float(v[j, i])) for j in range(v.shape[0]) for i in range(v.shape[1])]


def _raster(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.j - 1, r.i - 1] = np.nan if r.value is None else r.value
    return out


def _holed(nlat, nlon, share=0.4):
    v = RNG.uniform(1, 9, (nlat, nlon))
    v[RNG.random(v.shape) < share] = np.nan
    return v


@pytest.mark.parametrize("periodic", [True, False])
@pytest.mark.parametrize("side", [4, 256])
def test_box_means(spark, periodic, side):
    nlat, nlon, ri, rj = 9, 13, 3, 2
    v = _holed(nlat, nlon)
    want = np.full(v.shape, np.nan)
    for j in range(nlat):
        for i in range(nlon):
            if not np.isnan(v[j, i]):
                columns = [(i + d) % nlon for d in range(-ri, ri + 1)] if periodic else range(max(0, i - ri), min(nlon, i + ri + 1))
                want[j, i] = np.nanmean([v[b, a] for b in range(max(0, j - rj), min(nlat, j + rj + 1)) for a in columns])
    got = _raster(tiles.box_mean(spark.createDataFrame(_rows(v), SCHEMA), "raster", nlon, nlat, ri, rj, periodic, side), v.shape)
    np.testing.assert_allclose(got, want, atol=1e-10)


@pytest.mark.parametrize("side", [5, 256])
def test_fills_from_squares(spark, side):
    nlat, nlon, least = 12, 25, 8.7
    v = _holed(nlat, nlon, 0.3)
    v[:, 3:9] = np.where(np.isnan(v[:, 3:9]), np.nan, 1.0)
    want = v.copy()
    for j in range(nlat):
        for i in range(nlon):
            if v[j, i] < least:
                for d in range(1, 13):
                    near = [v[b, a % nlon] for b in range(max(0, j - d), min(nlat, j + d + 1)) for a in range(i - d, i + d + 1)]
                    near = [x for x in near if x >= least]
                    if near:
                        want[j, i] = np.mean(near)
                        break
    bounds = spark.createDataFrame([(1, least), (2, 100.0)], "raster long, least double")
    both = spark.createDataFrame(_rows(v) + _rows(v, 2), SCHEMA)
    out = tiles.fill_from_squares(both, "raster", nlon, nlat, bounds, side=side)
    np.testing.assert_allclose(_raster(out.where("raster = 1"), v.shape), want, atol=1e-10)
    np.testing.assert_allclose(_raster(out.where("raster = 2"), v.shape), v)


def test_rasters_come_to_rest_each_in_its_own_step(spark):
    easy, hard = _holed(7, 40, 0.1), _holed(7, 40, 0.1)
    hard[1:6, 2:38] = np.nan
    none = np.full((7, 40), np.nan)
    rows = _rows(easy, 1) + _rows(hard, 2) + _rows(none, 3)[:5]
    one = tiles.relaxed_fill(spark.createDataFrame(rows, SCHEMA), "raster", 40, 7, side=256)
    cut = tiles.relaxed_fill(spark.createDataFrame(rows, SCHEMA), "raster", 40, 7, side=6)
    for raster in (1, 2, 3):
        a, b = (_raster(x.where(F.col("raster") == raster), (7, 40)) for x in (one, cut))
        np.testing.assert_allclose(a, b, atol=1e-12)
        assert np.isnan(a).all() if raster == 3 else not np.isnan(a[1:]).any()
    with pytest.raises(ValueError, match="still change"):
        tiles.relaxed_fill(spark.createDataFrame(_rows(hard), SCHEMA), "raster", 40, 7, most=3)
    assert tiles.relaxed_fill(spark.createDataFrame([], SCHEMA), "raster", 40, 7).count() == 0


def test_bounds_of_fills(spark):
    rows = [(1, 1, k, x) for k, x in enumerate([0.003, 0.001, 0.002, 0.251, 0.255, 0.12, 3.0, None])] + [(2, 1, 1, None), (3, 1, 1, 0.9), (4, 1, 1, 0.31), (4, 1, 2, 0.22)]
    got = {r.raster: r.least for r in tiles.fill_bounds(spark.createDataFrame(rows, SCHEMA), "raster", 0.5).collect()}
    assert got == {1: 0.25, 2: 0.01, 3: 0.5, 4: 0.22}


def test_columns_of_few_levels(spark):
    z = [5.0, 15.0, 30.0, 60.0]
    df = spark.createDataFrame([(0, []), (1, [3.0]), (2, [3.0, 1.0]), (3, [9.0, 8.0, 5.0]), (4, [9.0, 8.0, 5.0, 2.0])], "n int, v array<double>")
    got = {r.n: r.g for r in df.select("n", variances.gradients(F.col("v"), z).alias("g")).collect()}
    assert got[0] == [] and got[1] == [0.0] and got[2] == [0.2, 0.2]
    inner = (0.1 * (22.5 - 15) + 0.2 * (15 - 10)) / 12.5
    np.testing.assert_allclose(got[3], [inner] * 3)
    below = (0.2 * (45 - 30) + 0.1 * (30 - 22.5)) / 22.5
    np.testing.assert_allclose(got[4], [inner, inner, below, below])
    means = {r.n: r.m for r in df.select("n", variances.mean_of_levels(F.col("v"), 1).alias("m")).collect()}
    assert means[0] == [] and means[1] == [3.0] and means[3] == [8.5, 22 / 3, 6.5]
    thick = df.where("n = 4").select(variances.by_thickness(F.col("v"), z).alias("t")).first().t
    np.testing.assert_allclose(thick, [0.9, 0.8, 5.0 / 20, 2.0 / 40])


def test_bounds_at_the_surface(spark):
    rows = [([0.1, 0.1, 0.4, 0.1],), ([0.9, 0.85, 0.5, 0.9],), ([0.1, 0.1],), ([0.3, 0.1],)]
    got = [r.s for r in spark.createDataFrame(rows, "v array<double>").select(variances.surface_within(F.col("v"), 0.2, 0.8).alias("s")).collect()]
    assert got == [[0.2, 0.2, 0.4, 0.1], [0.8, 0.8, 0.5, 0.9], [0.1, 0.1], [0.3, 0.1]]
