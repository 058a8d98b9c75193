"""Operators against brute force, identities and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import ensemble, seawater
from halocline.functions.geo import CUT_OFF
from halocline.operators import interpolation, profile_error, quality_control, spatial, superob, transform
from halocline.schema import EARTH_RADIUS, FilterConfig
from halocline.sources import records
from halocline.streaming import slots

RNG = np.random.default_rng(5)


def _xyz(lon, lat):
    lo, la = np.radians(lon), np.radians(lat)
    return EARTH_RADIUS * np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])


PLACES = [(0.5, 10.0), (359.5, 10.0), (180.0, 89.9), (0.0, 90.0), (0.0, -90.0), (10.0, -89.0), (0.5, 10.0), (45.0, 0.0), (48.0, 3.0)]


def test_within_meets_over_date_line_and_poles(spark):
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(PLACES)] + [(99, None, 1.0)], "point int, lon double, lat double")
    o = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(PLACES)] + [(99, 1.0, None)], "obs_id int, lon double, lat double")
    want = sorted((i, j) for i, a in enumerate(PLACES) for j, b in enumerate(PLACES) if np.linalg.norm(_xyz(*a) - _xyz(*b)) <= 500_000)
    assert sorted((r.point, r.obs_id) for r in spatial.within(p, o, 500_000.0).collect()) == want


def _assimilation(spark, config, n_obs=60, n_points=9, m=5):
    obs = [(i, 3073 if i % 3 else 5525, float(RNG.uniform(0, 30)), float(RNG.uniform(-15, 15)), 0.0, float(RNG.normal()), float(RNG.uniform(0.5, 2)), (y - y.mean()).tolist()) for i, y in enumerate(RNG.normal(size=(n_obs, m)))]
    points = [(k, float(k * 3), float(k - 4), 0.0, k % 2 == 0) for k in range(n_points)]
    o = spark.createDataFrame(obs, "obs_id long, elem int, lon double, lat double, lev double, dep double, err double, pert array<double>")
    p = spark.createDataFrame(points, "point long, lon double, lat double, lev double, upper boolean")
    return obs, points, o, p


@pytest.mark.parametrize("block", [20_000, 4])
def test_transforms_are_those_of_all_observations_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(transform, "BLOCK_OBS", block)
    config = FilterConfig(sigma_equator=300_000.0, sigma_pole=100_000.0, inflation=1.2)
    obs, points, o, p = _assimilation(spark, config)
    got = {r.point: r for r in transform.transforms(p, o, config).collect()}
    for name, lon, lat, _, upper in points:
        sigma = (1 - abs(lat) / 90) * 200_000 + 100_000
        near = [(x, np.linalg.norm(_xyz(x[2], x[3]) - _xyz(lon, lat))) for x in obs if upper or x[1] != 5525]
        near = [(x, d) for x, d in near if d <= CUT_OFF * sigma]
        if not near:
            assert name not in got
            continue
        y, d = np.array([x[7] for x, _ in near]), np.array([x[5] for x, _ in near])
        w = np.array([math.exp(-0.5 * (dist / sigma) ** 2) / x[6] ** 2 for x, dist in near])
        a = (y * w[:, None]).T @ y + np.eye(5) * 4 / 1.2
        pa = np.linalg.inv(a)
        t = np.array(got[name].trans).reshape(5, 5)
        mean = pa @ (y * w[:, None]).T @ d
        square = t - mean[:, None]
        assert got[name].n_obs == len(near)
        np.testing.assert_allclose(square, square.T, atol=1e-9)
        np.testing.assert_allclose(square @ square, 4 * pa, atol=1e-9)
        np.testing.assert_allclose(square.sum(axis=0), math.sqrt(1.2), atol=1e-9)


def test_level_counts_for_types_at_a_level_only(spark):
    config = FilterConfig(sigma_equator=300_000.0, sigma_pole=100_000.0, vertical_localisation=True, sigma_vertical=10.0)
    p = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, True)], "point long, lon double, lat double, lev double, upper boolean")
    rows = [(k, elem, 0.0, 0.0, 0.0, 0.5, 1.0, [1.0, -1.0]) for k, elem in enumerate((5526, 5351, 3073, 5525))]
    o = spark.createDataFrame(rows, "obs_id long, elem int, lon double, lat double, lev double, dep double, err double, pert array<double>")
    # Sea level acts at depth, temperature at the surface does not.
    assert [r.n_obs for r in transform.transforms(p, o, config).collect()] == [2]


def test_errors_without_bound_leave_the_ensemble(spark):
    config = FilterConfig(sigma_equator=300_000.0, sigma_pole=100_000.0)
    _, _, o, p = _assimilation(spark, config)
    for r in transform.transforms(p, o.withColumn("err", F.lit(1e12)), config).collect():
        np.testing.assert_allclose(np.array(r.trans).reshape(5, 5), np.eye(5), atol=1e-9)


def test_pressure_check_value(spark):
    got = spark.range(1).select(seawater.pressure_from_depth(F.lit(7321.45), F.lit(30.0)).alias("p"), seawater.potential_temperature(F.lit(40.0), F.lit(40.0), F.lit(10000.0), F.lit(0.0)).alias("t")).first()
    # The published value, 7500.004, was worked out in single precision.
    assert abs(got.p - 7500.004) < 0.005
    # Published check value of the potential temperature.
    assert abs(got.t - 36.89073) < 1e-4


def test_profile_without_values_and_at_the_deepest_level_only(spark):
    rows = [(1, k, 10.0 * k, None) for k in range(1, 4)] + [(2, k, 10.0 * k, 5.0 if k == 3 else None) for k in range(1, 4)] + [(3, k, 10.0 * k, 7.0) for k in range(1, 4)]
    df = spark.createDataFrame(rows, "profile int, level int, depth double, value double")
    got = {(r.profile, r.level): r.err for r in profile_error.profile_error(df).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [999.0] * 3
    assert [got[2, k] for k in (1, 2, 3)] == [999.0, 999.0, 1.0]
    assert [got[3, k] for k in (1, 2, 3)] == [1.0] * 3


def test_quality_edges(spark):
    rows = [(1, 5522, 60.0, 29.0, 5.0, [29.0, 29.0], [1, 1]), (2, 5522, 0.0, 40.0, 5.0, [40.0, 40.0], [1, 1]), (3, 5522, 0.0, 40.5, 5.0, [40.0, 40.0], [1, 1]), (4, 3073, 60.5, 1.0, 5.0, [1.0, 1.0], [1, 1]), (5, 3073, 0.0, 1.0, 5.0, [1.0, 1.0], [1, 0]), (6, 3073, 0.0, 1.0, 5.0, [], [])]
    df = spark.createDataFrame(rows, "obs_id int, elem int, lat double, dat double, err double, hx array<double>, qc_members array<int>")
    assert {r.obs_id: r.qc for r in quality_control.ensemble_check(df).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}


def test_superobs_drop_single_observations(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, None)], "i int, dat double")
    assert [(r.i, r.n) for r in superob.superob(df, ["i"], 0.1).collect()] == [(1, 2)]


def test_records_round_trip(spark, tmp_path):
    rows = np.array([[3073, 10, -5, 20, 4.5, 1], [5521, 359.5, 60, 0, 35, 0.5]])
    (tmp_path / "obs01001.dat").write_bytes(records.record_bytes(rows))
    (tmp_path / "obs01002.dat").write_bytes(b"")
    got = records.read_records(spark, str(tmp_path), "obs1").orderBy("rid").collect()
    assert [[r.elem, r.lon, r.lat, r.lev, r.dat, r.err] for r in got] == rows.tolist()
    with pytest.raises(ValueError):
        records.record_values(b"\0" * 12, 6)


def test_fixed_width(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  12.500  200.25\nbad\n")
    got = records.read_fixed_width(spark, str(tmp_path), {"lat": (1, 8), "lon": (9, 8)}).collect()
    assert sorted((r.lat or 0, r.lon or 0) for r in got) == [(0, 0), (12.5, 200.25)]


def test_stream_of_superobs_is_that_of_the_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0, 0, 0, 0, id % 50) AS ts, 3073 AS elem, CAST(id % 3 AS INT) AS i, 1 AS j, CAST(id AS DOUBLE) AS dat FROM range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = slots.slot_superobs(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("superobs").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    key = lambda r: (r.slot_start, r.i, r.n, round(r.dat, 9), round(r.var, 6))
    assert sorted(map(key, spark.table("superobs").collect())) == sorted(map(key, slots.slot_superobs(rows).collect()))


def test_low_pass_keeps_a_constant(spark):
    got = spark.range(1).select(interpolation.lanczos(F.array_repeat(F.lit(2.0), 30), 0.1).alias("z"), ensemble.spread(F.array(F.lit(1.0), F.lit(3.0))).alias("s")).first()
    np.testing.assert_allclose(got.z, 2.0)
    assert round(got.s, 9) == round(math.sqrt(2), 9)
