"""Gridded files: headers choose what is read, sinks commit as a whole, and everything comes back as it was."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.schema import COUPLED
from halocline.sources import gridded, records

RNG = np.random.default_rng(41)
NLON, NLAT = 7, 5


def _archive(folder, name, fields):
    """A pair of files; fields: (name, step, layer, values)."""
    lines = [*(f"title {k}" for k in range(4)), "   22    'iversn' = version", "  010    'iexpt ' = experiment", "    3    'yrflag' = days", f"{NLON:5d}    'idm   ' = columns", f"{NLAT:5d}    'jdm   ' = rows", "field       time step  model day  k  dens        min              max"]
    words = -(-NLON * NLAT // gridded.PAD_WORDS) * gridded.PAD_WORDS
    with open(folder / f"{name}.a", "wb") as f:
        for field, step, layer, v in fields:
            lines.append(f"{field:<8}= {step:10d} {step / 24:10.2f} {layer:2d} 25.000 {np.nanmin(v):16.7E} {np.nanmax(v):16.7E}")
            record = np.full(words, gridded.VOID, dtype=">f4")
            record[: v.size] = np.where(np.isnan(v), gridded.VOID, v).ravel()
            f.write(record.tobytes())
    (folder / f"{name}.b").write_text("\n".join(lines) + "\n")


@pytest.fixture
def archive(spark, tmp_path):
    gridded.register(spark)
    fields = {(n, k): RNG.normal(size=(NLAT, NLON)).astype(np.float32) for n, k in (("srfhgt", 0), ("temp", 1), ("temp", 2), ("salin", 1))}
    fields["temp", 2][0, 3] = np.nan
    _archive(tmp_path, "archv.1", [(n, 100, k, v) for (n, k), v in fields.items()])
    _archive(tmp_path, "archv.2", [(n, 200, k, v + 1) for (n, k), v in fields.items()])
    return tmp_path, fields


def test_archives_come_back(spark, archive):
    folder, fields = archive
    rows = spark.read.format("layered_archive").load(str(folder)).collect()
    assert len(rows) == 2 * len(fields) * NLON * NLAT
    for r in rows:
        want = fields[r.field, r.k][r.j - 1, r.i - 1] + (0 if r.t == 100 else 1)
        assert r.value is None if np.isnan(want) else abs(r.value - want) < 1e-6
        assert r.file.endswith("archv.1.a" if r.t == 100 else "archv.2.a")


def test_records_that_are_not_asked_for_stay_unread(spark, archive):
    folder, fields = archive
    path = str(folder / "archv.1.b")
    every, one = gridded.read_grids(spark, path), gridded.read_grids(spark, path, fields=["temp"], levels=[2], times=[100])
    assert one.rdd.getNumPartitions() == 1 and every.rdd.getNumPartitions() == len(fields)
    want = {(i + 1, j + 1) for j in range(NLAT) for i in range(NLON) if fields["temp", 2][j, i] > 0}
    assert {(r.i, r.j) for r in one.where("value > 0").collect()} == want
    # A frame that was filtered is whole when it is used again.
    assert (every.count(), every.where("field = 'temp'").count(), every.count()) == (4 * NLON * NLAT, 2 * NLON * NLAT, 4 * NLON * NLAT)
    # A record that isn't asked for may be damaged.
    os.truncate(folder / "archv.1.a", 4 * gridded.PAD_WORDS * 3)
    assert gridded.read_grids(spark, path, fields=["temp", "srfhgt"]).count() == 3 * NLON * NLAT
    with pytest.raises(Exception, match="ends before"):
        gridded.read_grids(spark, path, fields=["salin"]).collect()


def test_rows_of_a_record_are_dealt_to_parts(spark, archive, monkeypatch):
    folder, fields = archive
    reader = gridded.ArchiveReader({"path": str(folder / "archv.1.b")})
    monkeypatch.setattr(gridded, "PART_CELLS", 2 * NLON)
    parts = reader.partitions()
    assert len(parts) == 3 * len(fields)
    got = np.full((NLAT, NLON), np.nan)
    for p in parts:
        if (p.record.name, p.record.k) == ("temp", 1):
            for batch in reader.read(p):
                got[batch.column("j").to_numpy() - 1, batch.column("i").to_numpy() - 1] = batch.column("value").to_numpy(zero_copy_only=False)
    np.testing.assert_allclose(got, fields["temp", 1])


def _control(folder, options, marked):
    v = {(t, n, k): RNG.normal(size=(NLAT, NLON)).astype(np.float32) for t in (1, 2) for n, k in (("t", 1), ("t", 2), ("ssh", 1))}
    order = ">" if "big_endian" in options else "<"
    with open(folder / "state.grd", "wb") as f:
        for x in v.values():
            own = x[::-1] if "yrev" in options else x
            mark = np.array([x.size * 4], dtype=f"{order}i4").tobytes() if marked else b""
            f.write(mark + own.astype(f"{order}f4").tobytes() + mark)
    lines = ["* made by hand", "DSET ^state.grd", "UNDEF -999.0", f"OPTIONS {options}", f"XDEF {NLON} LINEAR 2.5 5.0", f"YDEF {NLAT} LEVELS -40 -20 0", " 25 60", "ZDEF 2 LEVELS 5 15", "TDEF 2 LINEAR 00Z01JAN2000 1dy", "VARS 2", "t 2 99 temperature", "ssh 0 99 height", "ENDVARS"]
    (folder / "state.ctl").write_text("\n".join(lines))
    return v


@pytest.mark.parametrize("options", ["big_endian", "little_endian yrev", "big_endian sequential yrev"])
def test_described_rasters(spark, tmp_path, options):
    gridded.register(spark)
    v = _control(tmp_path, options, "sequential" in options)
    df = spark.read.format("described_raster").load(str(tmp_path / "state.ctl"))
    rows = df.collect()
    assert len(rows) == 6 * NLON * NLAT
    for r in rows:
        assert abs(r.value - v[r.t, r.field, r.k][r.j - 1, r.i - 1]) < 1e-6
        assert (r.lon, r.lat) == (2.5 + 5 * (r.i - 1), [-40, -20, 0, 25, 60][r.j - 1]) and r.lev == ([5, 15][r.k - 1] if r.field == "t" else None)
    one = gridded.read_grids(spark, str(tmp_path / "state.ctl"), "described_raster", fields=["ssh", "none"], times=[1])
    assert one.rdd.getNumPartitions() == 1 and one.count() == NLON * NLAT
    (tmp_path / "bad.ctl").write_text("DSET ^x\nXDEF 1 LINEAR 0 1\n")
    with pytest.raises(Exception, match="missing"):
        gridded.described(str(tmp_path / "bad.ctl"))


def _cells(spark, fields):
    rows = [(n, k, i + 1, j + 1, None if np.isnan(v[j, i]) else float(v[j, i])) for (n, k), v in fields.items() for j in range(NLAT) for i in range(NLON)]
    return spark.createDataFrame(rows, "field string, k int, i int, j int, value double")


@pytest.mark.parametrize("order", ["big", "little"])
def test_rasters_are_written_whole_or_not_at_all(spark, tmp_path, order):
    fields = {(n, k): RNG.normal(size=(NLAT, NLON)).astype(np.float32).astype(float) for n, k in (("t", 1), ("t", 2), ("ssh", 1))}
    cells, shape = _cells(spark, fields), [("t", 2), ("ssh", 1)]
    path = str(tmp_path / "out.grd")
    gridded.write_raster(cells, path, NLON, NLAT, shape, order)
    back = records.read_raster(spark, path, NLON, NLAT, shape, ">" if order == "big" else "<").collect()
    assert {(r["var"], r.k, r.ij): r.value for r in back} == {(n, k, j * NLON + i + 1): v[j, i] for (n, k), v in fields.items() for j in range(NLAT) for i in range(NLON)}
    with pytest.raises(Exception, match="exists"):
        gridded.write_raster(cells, path, NLON, NLAT, shape, order)
    before = os.listdir(tmp_path)
    broken = cells.withColumn("value", F.when((F.col("field") == "ssh") & (F.col("j") == 3), F.raise_error(F.lit("a task fails")).cast("double")).otherwise(F.col("value")))
    for bad, said in ((broken, "a task fails"), (cells.where("not (i = 2 and j = 2)"), "were written"), (cells.union(cells.limit(1)), "were written"), (cells.withColumn("i", F.col("i") + 1), "outside")):
        with pytest.raises(Exception, match=said):
            gridded.write_raster(bad, str(tmp_path / "other.grd"), NLON, NLAT, shape, order)
        assert os.listdir(tmp_path) == before
    gridded.write_raster(cells.withColumn("value", F.lit(2.0)), path, NLON, NLAT, shape, order, mode="overwrite")
    assert {r.value for r in records.read_raster(spark, path, NLON, NLAT, shape, ">" if order == "big" else "<").collect()} == {2.0}


@pytest.mark.parametrize("extended", [True, False])
def test_records_are_written_by_tasks_and_come_back(spark, tmp_path, extended):
    rows = [(3073, float(n), float(n % 60), 10.0, n * 0.5, 1.0, 3.0, 0.25, 1.5, n % 2) for n in range(500)]
    obs = spark.createDataFrame(rows, COUPLED).repartition(6)
    path = str(tmp_path / "obs")
    gridded.write_records(obs, path, extended)
    assert len(os.listdir(path)) == 6 and len(os.listdir(tmp_path)) == 1
    names = [f.name for f in COUPLED.fields][: 10 if extended else 7]
    if extended:
        back = records.read_records(spark, path, "coupled").select(*names).collect()
    else:
        files = spark.read.format("binaryFile").load(path).collect()
        back = [tuple(float(x) for x in v) for f in files for v in records.record_values(bytes(f.content), 7)]
    assert sorted(tuple(map(float, r)) for r in back) == sorted(tuple(map(float, r[: len(names)])) for r in rows)
    with pytest.raises(Exception, match="has files"):
        gridded.write_records(obs, path, extended)
    broken = obs.withColumn("lev", F.when(F.col("lon") == 499, F.raise_error(F.lit("a task fails")).cast("double")).otherwise(F.col("lev")))
    with pytest.raises(Exception, match="a task fails"):
        gridded.write_records(broken, str(tmp_path / "more"), extended)
    assert os.listdir(tmp_path) == ["obs"]
    gridded.write_records(obs.limit(3), path, extended, mode="overwrite")
    assert sum(len(records.record_values(bytes(f.content), len(names))) for f in spark.read.format("binaryFile").load(path).collect()) == 3
