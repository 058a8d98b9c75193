"""Streams that stop and start again give what one batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators.superob import superob
from halocline.schema import FilterConfig
from halocline.streaming import cycles, slots

RNG = np.random.default_rng(51)
M = 5


def test_running_superobs_survive_a_restart(spark, tmp_path):
    cycles.use_state_store(spark)
    schema = "elem int, i int, j int, dat double"
    rows = [(5525, int(a), int(b), float(x)) for a, b, x in zip(RNG.integers(0, 4, 400), RNG.integers(0, 3, 400), RNG.normal(15, 3, 400))] + [(5525, 90, 90, 1.0), (5525, 91, 90, None), (3073, 0, 0, 2.0), (3073, 0, 0, 4.0)]
    got: dict = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r.elem, r.i, r.j] = (r.n, r.dat, r.err)

    source, turns = tmp_path / "in", 0
    source.mkdir()
    for k in range(4):
        # The query ends and starts anew before each pair of files.
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
        for f in (tmp_path / f"part-{k}").glob("*.parquet"):
            f.rename(source / f"{k}-{f.name}")
        if k % 2:
            stream = cycles.running_superobs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), 0.2, 1.5)
            q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert q.exception() is None
            turns += 1
    assert turns == 2
    want = {(r.elem, r.i, r.j): (r.n, r.dat, r.err) for r in superob(spark.createDataFrame(rows, schema), ["elem", "i", "j"], 0.2, 1.5).collect()}
    assert got.keys() == want.keys() and (5525, 90, 90) not in got
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)


_OBS = "obs_id long, elem int, lon double, lat double, lev double, dat double, err double, hx array<double>, qc_members array<int>"


def _obs(k):
    rows = []
    for n in range(6):
        hx = RNG.normal(10, 1, M)
        rows.append((10 * k + n, 3073, float(n), 4.0, 0.0, float(hx.mean() + RNG.normal() * 0.3), 1.0, hx.tolist(), [1] * M))
    return rows


@pytest.mark.parametrize("stop", [False, True])
def test_cycles_carry_state_and_inflation(spark, tmp_path, stop):
    config = FilterConfig(sigma_equator=200_000.0, sigma_pole=200_000.0, inflation=1.1, physical_limits={})
    points = spark.createDataFrame([(p, float(p), 4.0, 0.0, True, None, [1.3, None, 1.05][p % 3], 0 if p == 4 else 5) for p in range(6)], "point long, lon double, lat double, lev double, upper boolean, mixed int, inflation double, kmt int")
    state = spark.createDataFrame([(p, k, "t", 0 if p == 4 else 5, RNG.normal(10, 1, M).tolist()) for p in range(6) for k in (1, 2)], "point long, k int, var string, kmt int, ens array<double>")
    warmer = lambda df: df.withColumn("ens", F.transform("ens", lambda x: x + 0.5))
    batches = [_obs(k) for k in range(3)]
    # By hand, a cycle after the other.
    want, grid = state, points
    for k, rows in enumerate(batches):
        want, grid = cycles.one_cycle(warmer(want) if k else want, grid, spark.createDataFrame(rows, _OBS), config)
        want, grid = (spark.createDataFrame(x.collect(), x.schema) for x in (want, grid))
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, _OBS).coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
        for f in (tmp_path / f"part-{k}").glob("*.parquet"):
            f.rename(source / f"{k}-{f.name}")
        if k == 0 and stop or k == 2:
            stream = spark.readStream.schema(_OBS).option("maxFilesPerTrigger", 1).parquet(str(source))
            q = cycles.run_cycles(stream, state, points, str(tmp_path / "out"), str(tmp_path / "ck"), config, warmer)
            q.awaitTermination()
            assert q.exception() is None
    got = {(r.point, r.k): r.ens for r in spark.read.parquet(str(tmp_path / "out" / "state-000002")).collect()}
    for r in want.collect():
        np.testing.assert_allclose(got[r.point, r.k], r.ens, atol=1e-10)
    used = {r.point: r.inflation for r in spark.read.parquet(str(tmp_path / "out" / "points-000002")).collect()}
    assert used == {0: 1.3, 1: 1.1, 2: 1.05, 3: 1.3, 4: 0.0, 5: 1.05}
    assert not (tmp_path / "out" / "state-000003").exists()


def test_a_failed_cycle_runs_again_from_the_same_state(spark, tmp_path):
    calls = []

    def step(batch, number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out-{number}"))

    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = slots.cycle(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), step, str(tmp_path / "ck"))
        try:
            q.awaitTermination()
        except Exception:
            assert len(calls) == 1
    assert calls == [0, 0] and spark.read.parquet(str(tmp_path / "out-0")).count() == 5
