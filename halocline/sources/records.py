"""Record files as tables: length-marked records, rasters and fixed-width text.

Files are read whole by tasks that Spark hands out (one file is one time slot of
one member); paths may be in any store that Spark reads. Writers put one file per
member through ordinary DataFrame writes, as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import COUPLED, DRIFTER, OBS1, OBS2, OBS3

LAYOUTS = {"obs1": OBS1, "obs2": OBS2, "obs3": OBS3, "drifter": DRIFTER, "coupled": COUPLED}
_FIXED_WIDTH = {"lat": (1, 8), "lon": (9, 9), "year": (18, 5), "day": (23, 4), "value": (27, 9)}


def record_values(content: bytes, width: int, order: str = ">") -> np.ndarray:
    """Values of records of ``width`` 4-byte reals, each between two equal 4-byte lengths."""
    kind = np.dtype([("a", f"{order}i4"), ("v", f"{order}f4", (width,)), ("z", f"{order}i4")])
    if len(content) % kind.itemsize:
        raise ValueError("the file does not consist of whole records")
    rows = np.frombuffer(content, dtype=kind)
    if len(rows) and ((rows["a"] != 4 * width).any() or (rows["z"] != 4 * width).any()):
        raise ValueError("a record's length marks do not fit the layout")
    return rows["v"].astype(np.float64)


def read_records(spark: SparkSession, path: str, layout: str, order: str = ">", glob: str = "*.dat") -> DataFrame:
    """Rows of all files with file, rid (record number in the file) and the layout's columns. Empty files give no rows."""
    fields = LAYOUTS[layout].fields
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("rid", T.LongType()), *fields])
    whole = [isinstance(f.dataType, T.IntegerType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = record_values(content, len(fields), order)
                for i in range(0, len(v), 10_000):
                    part = v[i : i + 10_000]
                    columns = [pa.array(np.floor(np.abs(part[:, c]) + 0.5) * np.sign(part[:, c]), pa.float64()).cast(pa.int32()) if whole[c] else pa.array(part[:, c]) for c in range(len(fields))]
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(np.arange(i, i + len(part))), *columns], names=schema.fieldNames())

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def record_bytes(rows: np.ndarray, order: str = ">") -> bytes:
    """The inverse of ``record_values``."""
    kind = np.dtype([("a", f"{order}i4"), ("v", f"{order}f4", (rows.shape[1],)), ("z", f"{order}i4")])
    out = np.zeros(len(rows), dtype=kind)
    out["a"] = out["z"] = 4 * rows.shape[1]
    out["v"] = rows
    return out.tobytes()


def read_raster(spark: SparkSession, path: str, nlon: int, nlat: int, fields: list[tuple[str, int]], order: str = ">", glob: str = "*.grd") -> DataFrame:
    """file, var, k, ij, value of direct-access 4-byte rasters: each (variable, number of levels) in turn. Columns prune to the value only."""
    total = sum(n for _, n in fields)
    names = [v for v, n in fields for _ in range(n)]
    levels = [k + 1 for _, n in fields for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(content, dtype=f"{order}f4")
                if v.size != total * nlon * nlat:
                    raise ValueError("the raster's size does not fit its fields")
                v = v.reshape(total, -1)
                for r in range(total):
                    n = v.shape[1]
                    yield pa.record_batch([pa.array([name] * n), pa.array([names[r]] * n), pa.array(np.full(n, levels[r], np.int32)), pa.array(np.arange(1, n + 1)), pa.array(v[r].astype(np.float64))], ["file", "var", "k", "ij", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "file string, var string, k int, ij long, value double")


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Doubles at fixed columns (first, width) of text lines; blanks are null."""
    columns = columns or _FIXED_WIDTH
    lines = spark.read.text(path)
    return lines.select(*[F.expr(f"try_cast(trim(substring(value, {a}, {n})) AS DOUBLE)").alias(c) for c, (a, n) in columns.items()])


def empty_observations(spark: SparkSession, layout: str = "obs2") -> DataFrame:
    return spark.createDataFrame([], LAYOUTS[layout])


def write_observations(obs: DataFrame, path: str, accepted_only: bool = False, append: bool = False) -> None:
    """Parquet by slot where there is one; ``accepted_only`` keeps rows with oqc other than 0."""
    out = obs.where("oqc <> 0") if accepted_only else obs
    writer = out.write.mode("append" if append else "errorifexists")
    (writer.partitionBy("slot") if "slot" in out.columns else writer).parquet(path)


def write_members(state: DataFrame, path: str) -> None:
    """State rows (member, ...) in a folder for each member."""
    state.write.partitionBy("member").parquet(path)
