"""Options of the analysis: basins, mixed layer, additive draws, and runs without observations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import transform
from halocline.plans.analysis import analysis
from halocline.schema import FilterConfig

ENS = [9.0, 10.0, 11.0, 12.0, 8.0]


def _run(spark, config, elem=3073, lat=10.0, obs_lon=277.0, dat=10.5):
    """One column at 275 E, of levels 1 to 3 (the first two mixed), and one observation."""
    obs = spark.createDataFrame([(1, elem, obs_lon, lat, 0.0, dat, 1.0, [9.5, 10.0, 11.0, 11.5, 8.5], [1] * 5)], "obs_id long, elem int, lon double, lat double, lev double, dat double, err double, hx array<double>, qc_members array<int>")
    points = spark.createDataFrame([(7, 275.0, lat, 0.0, True, 2)], "point long, lon double, lat double, lev double, upper boolean, mixed int")
    state = spark.createDataFrame([(7, k, "x", 5, ENS, [1.0, 2.0, 3.0, 4.0, 10.0]) for k in (1, 2, 3)], "point long, k int, var string, kmt int, ens array<double>, addi array<double>")
    out = analysis(state, points, obs, config).orderBy("k").collect()
    assert [(r.point, r.k) for r in out] == [(7, 1), (7, 2), (7, 3)]
    return np.array([r.ana for r in out])


def test_basins(spark):
    blocked = _run(spark, FilterConfig(block_basins=True))
    np.testing.assert_allclose(blocked, [ENS] * 3)
    assert abs(_run(spark, FilterConfig()) - ENS).max() > 0.01
    assert abs(_run(spark, FilterConfig(block_basins=True), obs_lon=275.5) - ENS).max() > 0.01


def test_mixed_layer(spark):
    got = _run(spark, FilterConfig(mixed_layer=True), elem=5525)
    assert abs(got[:2] - ENS).max() > 0.01
    np.testing.assert_allclose(got[2], ENS)
    np.testing.assert_allclose(_run(spark, FilterConfig(mixed_layer=True)), _run(spark, FilterConfig()))


def test_additive_draws(spark):
    plain, more = _run(spark, FilterConfig()), _run(spark, FilterConfig(additive=0.5))
    np.testing.assert_allclose(more - plain, [[-1.5, -1.0, -0.5, 0.0, 3.0]] * 3, atol=1e-12)
    with pytest.raises(ValueError):
        transform.analyse(spark.range(1).select(F.col("id").alias("point")), None, FilterConfig(additive=0.5))


def test_no_accepted_observation_leaves_the_ensemble(spark):
    np.testing.assert_array_equal(_run(spark, FilterConfig(inflation=1.5), dat=1e6), [ENS] * 3)


def test_inflation_of_a_point_replaces_that_of_the_settings(spark):
    obs = spark.createDataFrame([(1, 3073, 0.0, 0.0, 0.0, 0.5, 1.0, [1.0, -1.0])], "obs_id long, elem int, lon double, lat double, lev double, dep double, err double, pert array<double>")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, True, 1.5), (2, 0.0, 0.0, 0.0, True, -1.0)], "point long, lon double, lat double, lev double, upper boolean, inflation double")
    got = {r.point: r.trans for r in transform.transforms(points, obs, FilterConfig(inflation=1.1)).collect()}
    for point, factor in ((1, 1.5), (2, 1.1)):
        alone = transform.transforms(points.drop("inflation").where(F.col("point") == point), obs, FilterConfig(inflation=factor)).first()
        np.testing.assert_allclose(got[point], alone.trans)


def test_layer_thickness_stays_when_it_is_not_updated(spark):
    rows = spark.createDataFrame([("h", 5, [1.0, 2.0], [3.0, 4.0]), ("t", 5, [1.0, 2.0], [3.0, 4.0])], "var string, kmt int, ens array<double>, ana array<double>")
    got = {r["var"]: r.ana for r in transform.finished(rows, FilterConfig(update_thickness=False)).collect()}
    assert got == {"h": [1.0, 2.0], "t": [3.0, 4.0]}
