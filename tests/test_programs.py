"""Matching, masks, splines, fills and observation operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import diagnostics, interpolation, masks, matching, tiles
from halocline.plans import observation_operators as programs

RNG = np.random.default_rng(12)


def test_one_to_one_raises_on_a_missing_or_double_partner(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, t double")
    good = spark.createDataFrame([(2, 35.0), (1, 34.0)], "k long, s double")
    assert {tuple(r) for r in matching.one_to_one(a, good, ["k"]).collect()} == {(1, 2.0, 34.0), (2, 3.0, 35.0)}
    for bad in ([(1, 34.0)], [(1, 34.0), (2, 35.0), (2, 36.0)], [(1, 34.0), (2, 35.0), (3, 1.0)]):
        with pytest.raises(Exception, match="one to one"):
            matching.one_to_one(a, spark.createDataFrame(bad, "k long, s double"), ["k"]).select("t").collect()


def test_as_of_takes_the_latest_not_later(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, "c", 3), (5, "a", 7)], "n long, id string, t long")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 6, 60.0), ("b", 10, 1.0)], "id string, t long, x double")
    got = {r.n: r.x for r in matching.as_of(left, right, "id", "t", ["x"]).collect()}
    assert got == {1: 50.0, 2: None, 3: None, 4: None, 5: 60.0}


def _akima(x, y, z):
    s = np.diff(y) / np.diff(x)
    s = np.concatenate(([3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]))

    def tangent(p):
        a, b = abs(s[p + 3] - s[p + 2]), abs(s[p + 1] - s[p])
        return 0.0 if a + b == 0 else (a * s[p + 1] + b * s[p + 2]) / (a + b)

    i = max(k for k in range(len(x) - 1) if x[k] <= z)
    d, h, t, u = z - x[i], x[i + 1] - x[i], tangent(i), tangent(i + 1)
    return y[i] + d * t + d * d * (3 * s[i + 2] - 2 * t - u) / h + d**3 * (t + u - 2 * s[i + 2]) / h / h


def test_akima_matches_the_formula_at_knots_and_between(spark):
    knots = {p: (np.sort(RNG.choice(100, 3 + p, replace=False)).astype(float), RNG.standard_normal(3 + p)) for p in range(6)}
    rows = [(p, float(a), float(b)) for p, (x, y) in knots.items() for a, b in zip(x, y)]
    targets = [(p, float(z)) for p, (x, _) in knots.items() for z in (x[0], x[-1], *RNG.uniform(x[0], x[-1], 8), x[0] - 1, x[-1] + 1)]
    found = interpolation.akima(spark.createDataFrame(rows, "p long, x double, y double"), spark.createDataFrame(targets, "p long, z double"), "p").collect()
    assert len(found) == len(targets)
    for r in found:
        x, y = knots[r.p]
        if not x[0] <= r.z <= x[-1]:
            assert r.value is None
        else:
            assert abs(r.value - (y[-1] if r.z == x[-1] else _akima(x, y, r.z))) < 1e-9


def _relaxed(v, tolerance, most, fold):
    """The rule of one step of the fill, cell by cell."""
    nlat, nlon = v.shape
    gaps = np.isnan(v)
    for _ in range(most):
        new, done = v.copy(), True
        for j in range(1, nlat):
            for i in range(nlon):
                if not gaps[j, i]:
                    continue
                near = [v[j, (i + 1) % nlon], v[j + 1, i] if j < nlat - 1 else (v[j, nlon - 1 - i] if fold else np.nan), v[j, i - 1], v[j - 1, i]]
                near = [x for x in near if not np.isnan(x)]
                n, total = len(near), sum(near)
                if not np.isnan(v[j, i]):
                    total, n = total + n * v[j, i], 2 * n
                if n:
                    new[j, i] = total / n
                    done &= not np.isnan(v[j, i]) and abs(v[j, i] - new[j, i]) <= tolerance * abs(v[j, i])
        v = new
        if done:
            break
    return v


@pytest.mark.parametrize("fold, side", [(True, 256), (False, 256), (True, 3), (False, 5)])
def test_fill_matches_the_rule_cell_by_cell(spark, fold, side):
    v = RNG.uniform(1, 9, (6, 8))
    v[RNG.random((6, 8)) < 0.4] = np.nan
    want = _relaxed(v.copy(), 1e-4, 500, fold)
    rows = [(7, i + 1, j + 1, None if np.isnan(v[j, i]) else float(v[j, i])) for j in range(6) for i in range(8)]
    got = tiles.relaxed_fill(spark.createDataFrame(rows, "raster long, i int, j int, value double"), "raster", 8, 6, most=500, fold=fold, side=side).collect()
    have = np.full((6, 8), np.nan)
    for r in got:
        have[r.j - 1, r.i - 1] = np.nan if r.value is None else r.value
    assert np.allclose(have, want, equal_nan=True)


def test_masks_and_reasons_of_an_operator(spark):
    field = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(1, 5) for j in range(1, 5)], "i int, j int, value double")
    grid = spark.createDataFrame([(i, j, 0 if (i, j) == (3, 3) else 5) for i in range(1, 5) for j in range(1, 5)], "i int, j int, kmt int")
    rows = [(1, 1.5, 2.0, 1.0), (2, 2.5, 2.5, 1.0), (3, 2.0, 2.0, 0.0), (4, 9.0, 2.0, 1.0), (5, 4.5, 2.0, 1.0), (6, None, 2.0, 1.0), (7, 2.6, 2.6, 1.0)]
    obs = spark.createDataFrame([(k, 5525, 100.0, 0.0, 0.0, 1.0, e, ri, rj) for k, ri, rj, e in rows], "obs_id long, elem int, lon double, lat double, lev double, dat double, err double, ri double, rj double")
    out = {r.obs_id: r for r in programs.observe(obs, field, grid, programs.Settings(4, 4, 1), False).collect()}
    assert out[1].oqc == 1 and abs(out[1].ohx - 17.0) < 1e-12
    assert {k: r.reason for k, r in out.items()} == {1: None, 2: "near_land", 3: "error", 4: "x_outside", 5: None, 6: "no_index", 7: "near_land"}
    # Between the last column and the first.
    assert abs(out[5].ohx - (42 + 12) / 2) < 1e-12
    nearest = {r.obs_id: r.reason for r in programs.observe(obs, field, grid, programs.Settings(4, 4, 1, mask=1), False).collect()}
    assert nearest[2] == "near_land" and nearest[7] == "near_land" and nearest[1] is None
    none = programs.observe(obs.where("err > 5"), field, grid, programs.Settings(4, 4, 1), False)
    assert none.count() == 0 and programs.obs2(none).columns[-1] == "obhr"
    assert {r.reason: r.n for r in programs.reasons(programs.observe(obs, field, grid, programs.Settings(4, 4, 1), False)).collect()}["accepted"] == 2


def test_identical_members_are_an_error(spark):
    same = spark.createDataFrame([([1.0, 1.0],), ([2.0, 2.0],)], "ens array<double>")
    with pytest.raises(ValueError):
        diagnostics.require_diversity(same, "ens")
    diagnostics.require_diversity(spark.createDataFrame([([1.0, 2.0],)], "ens array<double>"), "ens")


def test_converted_temperature_goes_back(spark):
    from halocline.functions import seawater

    x = spark.createDataFrame([(34.5, 12.0, 900.0)], "s double, t double, p double")
    there = x.withColumn("i", seawater.in_situ_temperature(F.col("s"), F.col("t"), F.col("p")))
    back = there.select(seawater.potential_temperature(F.col("s"), F.col("i"), F.col("p"), F.lit(0.0)).alias("t")).first()
    assert abs(back.t - 12.0) < 1e-3 and there.first().i > 12.0


def test_water_levels(spark):
    rows = [(1, 1, 10.0, 1.0), (1, 2, 5.0, 1.0), (1, 3, 0.0, 1.0), (2, 1, 10.0, 0.0)]
    got = masks.wet_levels(spark.createDataFrame(rows, "c int, k int, h double, wet double"), ["c"]).collect()
    assert {r.c: r.kmt for r in got} == {1: 2, 2: 0}
