"""Gridded binary files as data sources: layered archives, rasters with a descriptor, and sinks for rasters and records.

Readers plan from headers alone: a partition is one record (a field at a level and
a time) or some rows of it, found by its offset, so a task reads bounded bytes. The
options ``fields``, ``levels`` and ``times`` (names or numbers, by commas) leave all
other records unread. They are options and not filters pushed down by Spark: with
Python sources those stay with the frame, and a later use of it without the filter
then lacks rows.

Sinks write per task and commit together. A raster's tasks write the rows that they
have at their places in a file beside the target, which gets its name when every cell
has been written once; records go to a file for each task, moved to the folder when
all are done. If a task fails for good, or cells lack, what was written is deleted.

Paths are those of file systems that executors share, as pyarrow opens them.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import COUPLED
from .records import record_bytes

#: Cells that a partition reads.
PART_CELLS = 1 << 20
#: Records of layered archives are padded to this many words, and cells without a value have this one.
PAD_WORDS, VOID = 4096, 2.0**100


class Record(NamedTuple):
    """A level of a field in a file: where it starts, its names, and rows south to north or not."""

    file: str
    offset: int
    name: str
    k: int
    t: int
    lev: float | None


@dataclass
class Part(InputPartition):
    record: Record
    row: int
    rows: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _text(path: str) -> list[str]:
    system, name = _opened(path)
    with system.open_input_stream(name) as f:
        return f.read().decode("utf-8", errors="replace").splitlines()


def _listed(path: str, ending: str) -> list[str]:
    """The file, or the files of a folder with this ending, in order."""
    system, name = _opened(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(name)) if x.path.endswith(ending))
    return [path]


class GridReader(DataSourceReader):
    """Records with an axis each way; subclasses find the records."""

    nlon: int
    nlat: int
    order: str = ">"
    void: float = VOID
    lons: np.ndarray | None = None
    lats: np.ndarray | None = None
    flipped: bool = False

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        chosen = {k: [x.strip() for x in options[k].split(",")] for k in ("fields", "levels", "times") if options.get(k)}
        self.fields = chosen.get("fields")
        self.numbers = {column: [int(x) for x in chosen[k]] for column, k in (("k", "levels"), ("t", "times")) if k in chosen}

    def records(self) -> list[Record]:
        raise NotImplementedError

    def _wanted(self, record: Record) -> bool:
        return (self.fields is None or record.name in self.fields) and all(getattr(record, c) in own for c, own in self.numbers.items())

    def partitions(self) -> Sequence[InputPartition]:
        step = max(1, PART_CELLS // self.nlon)
        return [Part(r, row, min(step, self.nlat - row)) for r in self.records() if self._wanted(r) for row in range(0, self.nlat, step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        record, n = partition.record, partition.rows * self.nlon
        system, name = _opened(record.file)
        with system.open_input_file(name) as f:
            v = np.frombuffer(f.read_at(4 * n, record.offset + 4 * partition.row * self.nlon), dtype=f"{self.order}f4").astype(np.float64)
        if len(v) != n:
            raise ValueError(f"{record.file} ends before its record of {record.name}")
        row, i = np.divmod(np.arange(n), self.nlon)
        j = self.nlat - 1 - row - partition.row if self.flipped else row + partition.row
        # Single precision: a void value is met within its rounding.
        gone = np.isclose(v, np.float32(self.void), rtol=1e-6, atol=0)
        columns = [pa.array([record.file] * n), pa.array([record.name] * n), pa.array(np.full(n, record.k, np.int32)), pa.array(np.full(n, record.t, np.int32)), pa.array((i + 1).astype(np.int32)), pa.array((j + 1).astype(np.int32)), pa.array(v, mask=gone)]
        names = ["file", "field", "k", "t", "i", "j", "value"]
        if self.lons is not None:
            columns += [pa.array([record.lev] * n, pa.float64()), pa.array(self.lons[i]), pa.array(self.lats[j])]
            names += ["lev", "lon", "lat"]
        yield pa.record_batch(columns, names)


_CELLS = "file string, field string, k int, t int, i int, j int, value double"


class ArchiveReader(GridReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        sizes = {self._size(b) for b in self._headers()}
        if len(sizes) > 1:
            raise ValueError("the archives of a folder have one grid")
        self.nlon, self.nlat = sizes.pop() if sizes else (1, 1)

    def _headers(self) -> list[str]:
        return [x[:-2] + ".b" if x.endswith(".a") else x for x in _listed(self.path, ".b")]

    @staticmethod
    def _size(header: str) -> tuple[int, int]:
        found = {}
        for line in _text(header):
            if "'" in line and line.split("'")[1].strip() in ("idm", "jdm"):
                found[line.split("'")[1].strip()] = int(line.split("'")[0])
        return found["idm"], found["jdm"]

    def records(self) -> list[Record]:
        words = -(-self.nlon * self.nlat // PAD_WORDS) * PAD_WORDS
        out = []
        for header in self._headers():
            lines = _text(header)
            start = next(n for n, line in enumerate(lines) if line.startswith("field"))
            for n, line in enumerate(x for x in lines[start + 1 :] if "=" in x):
                name, rest = line.split("=", 1)
                step, _, layer = rest.split()[:3]
                out.append(Record(header[:-2] + ".a", 4 * n * words, name.strip(), int(layer), int(step), None))
        return out


class LayeredArchive(DataSource):
    """Pairs of a header (.b) and padded records (.a): format ``layered_archive``, path of a file or folder; t is the time step."""

    @classmethod
    def name(cls) -> str:
        return "layered_archive"

    def schema(self) -> str:
        return _CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class Descriptor(NamedTuple):
    """What a control file says: data file, axes, times, variables (name, levels), byte order, value of no data, rows from the north, bytes around a record."""

    file: str
    lons: list[float]
    lats: list[float]
    levs: list[float]
    times: int
    fields: list[tuple[str, int]]
    order: str
    void: float
    flipped: bool
    marked: bool


def _axis(words: list[str], lines: Iterator[str]) -> list[float]:
    """Numbers of an axis; a list may go on over lines."""
    n = int(words[1])
    if words[2].lower() == "linear":
        return [float(words[3]) + k * float(words[4]) for k in range(n)]
    if words[2].lower() != "levels":
        raise ValueError(f"an axis of {words[2]} is not known")
    values = [float(x) for x in words[3:]]
    while len(values) < n:
        values += [float(x) for x in next(lines).split()]
    return values


def described(path: str) -> Descriptor:
    """Read a control file; keywords in any case, comments start with ``*``."""
    lines = iter([x for x in _text(path) if x.strip() and not x.lstrip().startswith("*")])
    own: dict = {"times": 1, "order": "<", "void": VOID, "flipped": False, "marked": False}
    for line in lines:
        words = line.split()
        key = words[0].lower()
        if key == "dset":
            name = words[1]
            own["file"] = f"{path.rsplit('/', 1)[0]}/{name[1:]}" if name.startswith("^") else name
        elif key == "undef":
            own["void"] = float(words[1])
        elif key == "options":
            options = {w.lower() for w in words[1:]}
            if own["order"] != ">" and "big_endian" in options:
                own["order"] = ">"
            own["flipped"] |= "yrev" in options
            own["marked"] |= "sequential" in options
        elif key in ("xdef", "ydef", "zdef"):
            own[{"x": "lons", "y": "lats", "z": "levs"}[key[0]]] = _axis(words, lines)
        elif key == "tdef":
            own["times"] = int(words[1])
        elif key == "vars":
            own["fields"] = []
            for _ in range(int(words[1])):
                name, levels = next(lines).split()[:2]
                own["fields"].append((name.split("=>")[-1], int(levels)))
    try:
        return Descriptor(**own)
    except TypeError as lacks:
        raise ValueError(f"{path}: {lacks}") from None


class RasterReader(GridReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.about = described(self.path)
        self.nlon, self.nlat = len(self.about.lons), len(self.about.lats)
        self.order, self.void, self.flipped = self.about.order, self.about.void, self.about.flipped
        self.lons, self.lats = np.array(self.about.lons), np.array(self.about.lats)

    def records(self) -> list[Record]:
        size, at, out = 4 * self.nlon * self.nlat, 0, []
        for t in range(self.about.times):
            for name, levels in self.about.fields:
                for k in range(max(1, levels)):
                    at += 4 * self.about.marked
                    out.append(Record(self.about.file, at, name, k + 1, t + 1, self.about.levs[k] if levels else None))
                    at += size + 4 * self.about.marked
        return out


class DescribedRaster(DataSource):
    """Rasters with a control file: format ``described_raster``, path of the control file. k counts levels, t times; lev is null for fields without levels."""

    @classmethod
    def name(cls) -> str:
        return "described_raster"

    def schema(self) -> str:
        return _CELLS + ", lev double, lon double, lat double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(dict(self.options))


# ---- sinks


def _local(path: str) -> str:
    system, name = _opened(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError("sinks write to file systems that are mounted where tasks run")
    return name


@dataclass
class Written(WriterCommitMessage):
    cells: int
    files: list[str]


class RasterWriter(DataSourceArrowWriter):
    """Cells (field, k, i, j, value) at their places in one direct-access file."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.nlon, self.nlat, self.order = int(options["nlon"]), int(options["nlat"]), {"big": ">", "little": "<"}[options.get("order", "big")]
        self.void = float(options.get("void", VOID))
        self.start: dict[str, int] = {}
        total = 0
        for part in options["fields"].split(","):
            name, levels = part.split(":")
            self.start[name.strip()] = total
            total += int(levels)
        self.levels = total
        self.path = _local(options["path"])
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.beside = f"{self.path}.{uuid.uuid4().hex}.part"
        # Made here: tasks that still run when the rest has been given up don't bring it back.
        open(self.beside, "xb").close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        n = 0
        # Tasks open the file of all, each writes its own places: a repeated task writes the same again.
        with open(self.beside, "r+b") as f:
            for batch in iterator:
                k, i, j = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "i", "j"))
                names = np.array([self.start[x] for x in batch.column("field").to_pylist()], dtype=np.int64)
                if len(i) and not ((i >= 1) & (i <= self.nlon) & (j >= 1) & (j <= self.nlat) & (k >= 1)).all():
                    raise ValueError("a cell lies outside of the raster")
                v = batch.column("value").cast(pa.float64()).fill_null(self.void).to_numpy(zero_copy_only=False).astype(f"{self.order}f4")
                at = ((names + k - 1) * self.nlat + j - 1) * self.nlon + i - 1
                order = np.argsort(at, kind="stable")
                at, v = at[order], v[order]
                for a, b in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)])).tolist())):
                    if b > a:
                        f.seek(4 * int(at[a]))
                        f.write(v[a:b].tobytes())
                n += len(at)
        return Written(n, [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        cells = sum(m.cells for m in messages if m)
        want = self.levels * self.nlat * self.nlon
        if cells != want or os.path.getsize(self.beside) != 4 * want:
            self.abort(messages)
            raise ValueError(f"{cells} cells were written of {want}")
        os.replace(self.beside, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.exists(self.beside):
            os.remove(self.beside)


class RasterSink(DataSource):
    """Format ``raster_sink``: options path, nlon, nlat, fields (``t:3,s:3,ssh:1`` in the order of the file), order (big or little) and void."""

    @classmethod
    def name(cls) -> str:
        return "raster_sink"

    def schema(self) -> str:
        return "field string, k int, i int, j int, value double"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RasterWriter(dict(self.options), overwrite)


class RecordWriter(DataSourceArrowWriter):
    """Observations as length-marked records, a file for each task."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.columns = [f.name for f in COUPLED.fields][: 10 if options.get("extended", "false").lower() == "true" else 7]
        self.order = {"big": ">", "little": "<"}[options.get("order", "big")]
        self.path, self.overwrite = _local(options["path"]), overwrite
        if os.path.isdir(self.path) and os.listdir(self.path) and not overwrite:
            raise ValueError(f"{self.path} has files")
        self.beside = f"{self.path.rstrip('/')}.{uuid.uuid4().hex}.part"
        os.makedirs(self.beside)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, n = f"part-{uuid.uuid4().hex}.dat", 0
        with open(f"{self.beside}/{name}", "wb") as f:
            for batch in iterator:
                rows = np.stack([batch.column(c).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in self.columns], axis=1)
                f.write(record_bytes(rows, self.order))
                n += len(rows)
        return Written(n, [name])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that were counted move; those of attempts that were not are left and go."""
        if self.overwrite and os.path.isdir(self.path):
            shutil.rmtree(self.path)
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            for name in m.files if m and m.cells else []:
                os.replace(f"{self.beside}/{name}", f"{self.path}/{name}")
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class RecordSink(DataSource):
    """Format ``record_sink``: options path (a folder), extended (10 values a record, else 7) and order."""

    @classmethod
    def name(cls) -> str:
        return "record_sink"

    def schema(self) -> StructType:
        return COUPLED

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for source in (LayeredArchive, DescribedRaster, RasterSink, RecordSink):
        spark.dataSource.register(source)


def read_grids(spark: SparkSession, path: str, form: str = "layered_archive", fields: list[str] | None = None, levels: list[int] | None = None, times: list[int] | None = None) -> DataFrame:
    """Cells of the records that are asked for; None asks for all."""
    register(spark)
    chosen = {"fields": fields, "levels": levels, "times": times}
    return spark.read.format(form).options(**{k: ",".join(map(str, v)) for k, v in chosen.items() if v}).load(path)


def write_raster(cells: DataFrame, path: str, nlon: int, nlat: int, fields: list[tuple[str, int]], order: str = "big", mode: str = "append") -> None:
    """Cells (field, k, i, j, value) as one direct-access file; rows of a level are dealt to tasks together."""
    register(cells.sparkSession)
    rows = cells.select("field", "k", "i", "j", "value").repartition("field", "k").sortWithinPartitions("field", "k", "j", "i")
    rows.write.format("raster_sink").options(path=path, nlon=nlon, nlat=nlat, fields=",".join(f"{n}:{k}" for n, k in fields), order=order).mode(mode).save()


def write_records(obs: DataFrame, path: str, extended: bool = False, mode: str = "append") -> None:
    """Observations (columns of COUPLED) as record files in a folder."""
    register(obs.sparkSession)
    names = [f.name for f in COUPLED.fields]
    obs.select(*names).write.format("record_sink").options(path=path, extended=str(extended)).mode(mode).save()


def write_control(path: str, data: str, lons: tuple[float, float, int], lats: tuple[float, float, int], levs: list[float], fields: list[tuple[str, int]], order: str = "big", void: float = VOID) -> None:
    """A control file for one time of a raster: axes by first value, step and number; fields with their levels, 0 for none."""
    lines = [f"DSET {data}", f"UNDEF {void!r}", f"OPTIONS {order}_endian", f"XDEF {lons[2]} LINEAR {lons[0]!r} {lons[1]!r}", f"YDEF {lats[2]} LINEAR {lats[0]!r} {lats[1]!r}"]
    lines += [f"ZDEF {len(levs)} LEVELS {' '.join(map(repr, levs))}", "TDEF 1 LINEAR 00Z01JAN2000 1dy", f"VARS {len(fields)}", *(f"{name} {k} 99 {name}" for name, k in fields), "ENDVARS"]
    system, name = _opened(path)
    with system.open_output_stream(name) as f:
        f.write("\n".join(lines).encode())
