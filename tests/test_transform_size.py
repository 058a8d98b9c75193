"""What the transform sends from task to task: observations as they are while these are few, and the same results in all forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions.geo import CUT_OFF
from halocline.operators import transform
from halocline.schema import EARTH_RADIUS, FilterConfig

RNG = np.random.default_rng(23)
OBS = "obs_id long, elem int, lon double, lat double, lev double, dep double, err double, pert array<double>"
POINTS = "point long, lon double, lat double, lev double, upper boolean"
NEAR = FilterConfig(sigma_equator=1000.0, sigma_pole=1000.0, inflation=1.1)


def test_bytes_of_a_point_follow_its_observations(spark):
    m = 64
    obs = spark.createDataFrame([(i, 3073, float(i), 0.0, 0.0, 0.5, 1.0, RNG.normal(size=m).tolist()) for i in range(3)] + [(3 + i, 3073, 90.0, 0.0, 0.0, 0.5, 1.0, RNG.normal(size=m).tolist()) for i in range(100)], OBS)
    points = spark.createDataFrame([(i, float(x), 0.0, 0.0, True) for i, x in enumerate((0, 1, 2, 90))], POINTS)
    sums = {r.point: r.size for r in transform.local_sums(points, obs, NEAR).select("point", (F.length("a") + F.length("b")).alias("size")).collect()}
    packed = {r.point: r.size for r in transform.packed_transforms(points, obs, NEAR).select("point", F.length("trans").alias("size")).collect()}
    assert sums == {0: 8 * (m + 1), 1: 8 * (m + 1), 2: 8 * (m + 1), 3: 8 * (m * (m + 1) // 2 + m)}
    assert packed == {0: 8 * (2 * m + 4), 1: 8 * (2 * m + 4), 2: 8 * (2 * m + 4), 3: 8 * (m * (m + 1) // 2 + m + 3)}


@pytest.mark.parametrize("cuts", [[0, 1], [0, 3], [0, 2, 4], [0, 3, 5, 9], [0, 9, 11], [0, 2, 12, 13, 15]])
def test_all_forms_give_one_transform(cuts):
    """Parts of a point's observations, with one that tells nothing new and one of no weight."""
    m = 8
    c, e = RNG.normal(size=(cuts[-1], m)), RNG.normal(size=cuts[-1])
    if len(c) > 2:
        c[1], c[2] = c[0], 0.0
    point = transform._Sums(5, 0, 1.2)
    for a, b in zip(cuts[:-1], cuts[1:]):
        part, own, few = c[a:b], e[a:b], b - a
        if few > transform._most(m):
            part, own, few = transform._triangle(part.T @ part), part.T @ own, 0
        point.add(b - a, few, part.tobytes(), own.tobytes())
    inverse = np.linalg.inv(c.T @ c + np.eye(m) * (m - 1) / 1.2)
    values, vectors = np.linalg.eigh(inverse * (m - 1))
    want = (vectors * np.sqrt(values)) @ vectors.T + (inverse @ c.T @ e)[:, None]
    trans = transform._solved([point])[0]
    x = RNG.normal(size=(3, m))
    assert point.n == len(c)
    np.testing.assert_allclose(transform._expanded(trans).reshape(m, m), want, atol=1e-12)
    np.testing.assert_allclose(transform._applied(x, trans), x @ want, atol=1e-12)


def test_cubes_wider_than_the_radius_lose_nothing(spark):
    """Places over faces and corners of cubes, poles and the date line."""
    place = lambda lon, lat: EARTH_RADIUS * np.array([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))])
    centres = [(0.0, 0.0), (0.0, 90.0), (180.0, 0.0), (-90.0, -89.99), (45.0, 35.0), (0.0, np.degrees(np.arcsin(200_000 / EARTH_RADIUS)))]
    near = [(float(lon + RNG.uniform(-0.04, 0.04)), float(np.clip(lat + RNG.uniform(-0.04, 0.04), -90, 90))) for lon, lat in centres for _ in range(30)]
    points = [(k, lon, lat, 0.0, True) for k, (lon, lat) in enumerate(near[::2])]
    obs = [(k, 3073, lon, lat, 0.0, 0.5, 1.0, [1.0, -1.0]) for k, (lon, lat) in enumerate(near[1::2])]
    got = {r.point: r.n_obs for r in transform.transforms(spark.createDataFrame(points, POINTS), spark.createDataFrame(obs, OBS), NEAR).collect()}
    want = {p[0]: sum(np.linalg.norm(place(*p[1:3]) - place(*o[2:4])) <= 1000.0 * CUT_OFF for o in obs) for p in points}
    assert got == {p: n for p, n in want.items() if n} and sum(want.values()) > 300
