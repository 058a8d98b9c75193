"""Places on curvilinear grids: known places of a folded cap, rotated and twisted grids, and brute force for the nearest nodes."""

import math

import numpy as np
import pytest

from halocline.operators import curvilinear

RNG = np.random.default_rng(21)
DEGREES = math.degrees(2)


def _to_sphere(x, y):
    r = np.hypot(x, y)
    return np.degrees(np.arctan2(y, x)) % 360, 90 - 2 * np.degrees(np.arctan(r / DEGREES))


def _cap(nlon=24, nlat=6, size=12.0):
    """Confocal ellipses that close to a line across the pole: the last row and its mirror image are half a cell from it."""
    i, j = np.meshgrid(np.arange(1, nlon + 1), np.arange(1, nlat + 1))
    angle, u = 2 * np.pi * (i - 0.5) / nlon, 1.4 * (nlat - j + 0.5) / nlat
    return i, j, size * np.cosh(u) * np.cos(angle), size * np.sinh(u) * np.sin(angle)


def _frame(spark, i, j, lon, lat):
    return spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(i.ravel(), j.ravel(), lon.ravel(), lat.ravel())], "i int, j int, lon double, lat double")


def _inside(corners, a, b):
    p = [np.array(c) for c in corners]
    return (1 - a) * (1 - b) * p[0] + a * (1 - b) * p[1] + (1 - a) * b * p[2] + a * b * p[3]


def test_places_in_a_folded_cap(spark):
    nlon, nlat = 24, 6
    i, j, x, y = _cap(nlon, nlat)
    at = {(a, b): (p, q) for a, b, p, q in zip(i.ravel().tolist(), j.ravel().tolist(), x.ravel().tolist(), y.ravel().tolist())}
    for k in range(1, nlon + 1):
        at[k, nlat + 1] = at[nlon + 1 - k, nlat]
    want, rows = {}, []
    for n in range(300):
        ci, cj = int(RNG.integers(1, nlon + 1)), int(RNG.integers(1, nlat + 1))
        if cj == nlat and ci in (nlon // 2, nlon):
            # The ends of the fold, where a cell is its own mirror image, have no area.
            ci -= 1
        a, b = RNG.uniform(0.05, 0.95, 2)
        east = ci % nlon + 1
        place = _inside([at[ci, cj], at[east, cj], at[ci, cj + 1], at[east, cj + 1]], a, b)
        lon, lat = _to_sphere(*place)
        rows.append((n, float(lon), float(lat)))
        # A cell on the fold has two names; the lesser i counts.
        want[n] = (ci + a, cj + b) if cj < nlat or ci < nlon - ci else (nlon - ci + 1 - a, nlat + 1 - b)
    obs = spark.createDataFrame(rows, "obs_id long, lon double, lat double")
    grid = _frame(spark, i, j, *_to_sphere(x, y))
    got = {r.obs_id: (r.ri, r.rj) for r in curvilinear.quadrilateral_index(obs, grid, nlon, nlat, fold=True).collect()}
    assert len(got) == 300 and all(g[0] is not None for g in got.values())
    for n, w in want.items():
        np.testing.assert_allclose(got[n], w, atol=1e-6)
    open_ = {r.obs_id for r in curvilinear.quadrilateral_index(obs, grid, nlon, nlat).where("ri is null").collect()}
    assert open_ == {n for n in want if want[n][1] >= nlat}


def test_twisted_grid_across_the_date_line(spark):
    nlon, nlat = 12, 10
    i, j = np.meshgrid(np.arange(1, nlon + 1), np.arange(1, nlat + 1))
    lon, lat = 330 + 5.0 * i - 1.2 * j + 0.02 * i * j, -30 + 4.0 * j + 0.7 * i + 0.03 * i * j
    rows, want = [], {}
    for n in range(300):
        ci, cj = int(RNG.integers(1, nlon)), int(RNG.integers(1, nlat))
        a, b = RNG.uniform(0.01, 0.99, 2)
        corner = lambda di, dj: (lon[cj - 1 + dj, ci - 1 + di], lat[cj - 1 + dj, ci - 1 + di])
        p = _inside([corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1)], a, b)
        rows.append((n, float(p[0] % 360), float(p[1])))
        want[n] = (ci + a, cj + b)
    rows += [(1000, None, 1.0), (1001, 200.0, 5.0), (1002, 340.0, -89.0)]
    obs = spark.createDataFrame(rows, "obs_id long, lon double, lat double")
    got = {r.obs_id: (r.ri, r.rj) for r in curvilinear.quadrilateral_index(obs, _frame(spark, i, j, lon % 360, lat), nlon, nlat, periodic=False, step=3.0).collect()}
    for n, w in want.items():
        np.testing.assert_allclose(got[n], w, atol=1e-7)
    assert got[1000] == got[1001] == got[1002] == (None, None)


def test_nodes_edges_and_charts_of_a_regular_grid(spark):
    """Everywhere on a globe, also on nodes and edges, and close to where the charts meet."""
    nlon, nlat = 36, 18
    i, j = np.meshgrid(np.arange(1, nlon + 1), np.arange(1, nlat + 1))
    grid = _frame(spark, i, j, i * 10.0 - 5, j * 10.0 - 95)
    places = [(5.0, -85.0), (355.0, 84.0), (359.9, 0.0), (0.0, 60.0), (15.0, 25.0), (10.0, 25.0), *zip(RNG.uniform(0, 360, 300), RNG.uniform(-84, 84, 300)), *zip(RNG.uniform(0, 360, 100), RNG.uniform(59.5, 60.5, 100))]
    obs = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(places)], "obs_id long, lon double, lat double")
    for r in curvilinear.quadrilateral_index(obs, grid, nlon, nlat, step=5.0).collect():
        lon, lat = places[r.obs_id]
        ri, rj = (lon - 5) % 360 / 10 + 1, (lat + 85) / 10 + 1
        # In the polar charts edges along a parallel are straight, not round.
        slack = 1e-7 if abs(lat) <= 60 else 0.12
        assert min(abs(r.ri - ri), 36 - abs(r.ri - ri)) <= slack and abs(r.rj - rj) <= slack, (lon, lat, r)
    by_distance = curvilinear.quadrilateral_index(obs, grid, nlon, nlat, weights="distance", step=5.0).where("obs_id in (0, 4, 5)").orderBy("obs_id").collect()
    np.testing.assert_allclose([(r.ri, r.rj) for r in by_distance], [(1, 1), (2, 12), (1.5, 12)], atol=0.15)
    with pytest.raises(ValueError):
        curvilinear.quadrilateral_index(obs, grid, nlon, nlat, step=7.0)


def test_nearest_four_against_brute_force(spark):
    nlon, nlat = 20, 9
    i, j = np.meshgrid(np.arange(1, nlon + 1), np.arange(1, nlat + 1))
    lon, lat = (i * 18.0 + 3.3 * j) % 360, j * 15.0 - 75 + 0.1 * i
    rows = [(n, float(RNG.uniform(0, 360)), float(RNG.uniform(-60, 60))) for n in range(100)] + [(200, float(lon[3, 4]), float(lat[3, 4])), (201, None, 3.0)]
    obs = spark.createDataFrame(rows, "obs_id long, lon double, lat double")
    got = {r.obs_id: (r.ri, r.rj) for r in curvilinear.nearest_four_index(obs, _frame(spark, i, j, lon, lat), nlon, 4.0e6).collect()}
    for n, a, b in rows[:100]:
        la, lo = np.radians(lat.ravel()), np.radians(lon.ravel())
        d = np.arccos(np.clip(np.sin(la) * math.sin(math.radians(b)) + np.cos(la) * math.cos(math.radians(b)) * np.cos(lo - math.radians(a)), -1, 1))
        four = np.argsort(d)[:4]
        w = 1 / d[four] ** 2
        first = i.ravel()[four[0]]
        shift = (i.ravel()[four] - first + nlon / 2) % nlon - nlon / 2
        np.testing.assert_allclose(got[n], (first + (w * shift).sum() / w.sum(), (w * j.ravel()[four]).sum() / w.sum()), atol=1e-5)
    np.testing.assert_allclose(got[200], (5, 4), atol=1e-6)
    assert got[201] == (None, None)


def test_regular_field_at_the_nodes_of_a_cap(spark):
    i, j, x, y = _cap()
    lon, lat = _to_sphere(x, y)
    field = spark.createDataFrame([(a, b, 2.0 * b + (a % 2)) for a in range(1, 37) for b in range(1, 16)], "i int, j int, value double")
    targets = spark.createDataFrame([(n, float(a), float(b)) for n, (a, b) in enumerate(zip(lon.ravel(), lat.ravel()))] + [(999, 10.0, -89.0)], "cell long, lon double, lat double")
    got = {r.cell: r.hx for r in curvilinear.to_curvilinear(field, targets, 5.0, 10.0, 36, -65.0, 10.0, 15).collect()}
    for n, (a, b) in enumerate(zip(lon.ravel(), lat.ravel())):
        ri, rj = (a - 5) % 360 / 10, (b + 65) / 10 + 1
        at = int(ri)
        own = lambda k: 2.0 * rj + ((k % 36 + 1) % 2)
        want = 30.5 if rj > 15 else (1 - ri + at) * own(at) + (ri - at) * own(at + 1)
        assert abs(got[n] - want) < 1e-9
    assert got[999] is None
