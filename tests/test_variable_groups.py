"""Groups of variables: two groups give what two runs give, and equal weights cost one transform."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import transform
from halocline.plans.analysis import analysis
from halocline.schema import OBS_TYPES, FilterConfig

RNG = np.random.default_rng(17)
WEIGHTS = {"s": {"t": 0.0, "sst": 0.5}, "v": {"sst": 0.5, "t": 0.0, "s": 1.0}, "t": {}}


def _obs(spark, n=60, m=6):
    kinds = [OBS_TYPES[x] for x in ("t", "s", "sst")]
    rows = [(i, kinds[i % 3], float(RNG.uniform(0, 8)), float(RNG.uniform(0, 8)), 0.0, float(RNG.normal()), 1.0 + i % 2, [float(x) for x in RNG.normal(size=m)]) for i in range(n)]
    return spark.createDataFrame(rows, "obs_id long, elem int, lon double, lat double, lev double, dep double, err double, pert array<double>")


def _points(spark):
    return spark.createDataFrame([(p, float(p), 4.0, 0.0, True) for p in range(8)], "point long, lon double, lat double, lev double, upper boolean")


def test_groups_give_what_runs_of_their_own_give(spark):
    obs, points = _obs(spark), _points(spark)
    config = FilterConfig(sigma_equator=200_000.0, sigma_pole=200_000.0, variable_weights=WEIGHTS)
    of, groups = config.variable_groups()
    assert of["s"] == of["v"] != of["t"] == 0 and len(groups) == 2
    both = {(r.point, r.grp): r for r in transform.transforms(points, obs, config).collect()}
    assert {g for _, g in both} == {0, 1} and len(both) == 16
    # Alone, a weight is an error of 1 / sqrt(weight); types of weight 0 are left out.
    alone = obs.where(F.col("elem") != OBS_TYPES["t"]).withColumn("err", F.when(F.col("elem") == OBS_TYPES["sst"], F.col("err") * 2**0.5).otherwise(F.col("err")))
    for group, own in ((0, obs), (1, alone)):
        run = {r.point: r for r in transform.transforms(points, own, FilterConfig(sigma_equator=200_000.0, sigma_pole=200_000.0)).collect()}
        for p in range(8):
            assert both[p, group].n_obs == run[p].n_obs
            np.testing.assert_allclose(both[p, group].trans, run[p].trans, atol=1e-10)


def test_state_takes_the_transform_of_its_variable(spark):
    m = 5
    hx = [9.5, 10.0, 11.0, 11.5, 8.5]
    obs = spark.createDataFrame([(1, OBS_TYPES["t"], 1.0, 1.0, 0.0, 10.5, 1.0, hx, [1] * m)], "obs_id long, elem int, lon double, lat double, lev double, dat double, err double, hx array<double>, qc_members array<int>")
    points = spark.createDataFrame([(7, 1.0, 1.0, 0.0, True, None)], "point long, lon double, lat double, lev double, upper boolean, mixed int")
    ens = [9.0, 10.0, 11.0, 12.0, 8.0]
    state = spark.createDataFrame([(7, k, v, 5, ens) for k in (1, 70) for v in ("s", "t", "other", "v")], "point long, k int, var string, kmt int, ens array<double>")
    for config in (FilterConfig(variable_weights=WEIGHTS), FilterConfig(variable_weights=WEIGHTS, mixed_layer=True)):
        got = {(r["var"], r.k): r.ana for r in analysis(state, points, obs, config).collect()}
        assert len(got) == 8
        for k in (1, 70):
            np.testing.assert_allclose(got["s", k], ens)
            np.testing.assert_allclose(got["v", k], ens)
            np.testing.assert_allclose(got["t", k], got["other", k])
            assert abs(np.array(got["t", k]) - ens).max() > 0.01


def test_unknown_types_are_an_error():
    with pytest.raises(ValueError):
        FilterConfig(variable_weights={"t": {"nothing": 1.0}}).variable_groups()
