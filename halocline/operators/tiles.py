"""Rasters in tiles: stencils and relaxation with halos that neighbouring tiles exchange.

A raster is a grid of nlon by nlat cells (i, j from 1) with a value or none. It is
held as tiles of SIDE by SIDE cells. To look around, each tile sends every tile in
reach the part that lies in that one's halo, so a task holds one tile with its halo,
never a raster. Columns are periodic, and with ``fold`` the rows beyond the last are
the last ones in reverse order and direction. A relaxation takes as many steps at a
time as its halo is wide: the outermost cells of the halo go stale by one a step, the
tile's own are those of the whole raster. Rounds are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import checkpointed

SIDE = 256
#: Steps of a relaxation between two exchanges.
STEPS = 32
_TILE = "raster string, ti int, tj int, cells binary, open binary"
_BLOCK = "raster string, ti int, tj int, x int, y int, w int, h int, cells binary, open binary"


class Tiling(NamedTuple):
    """The shape of a raster and its tiles."""

    nlon: int
    nlat: int
    side: int = SIDE
    periodic: bool = True
    fold: bool = False

    def bounds(self, ti: int, tj: int) -> tuple[int, int, int, int]:
        """First column and row, and those behind the last."""
        return ti * self.side, tj * self.side, min(self.nlon, (ti + 1) * self.side), min(self.nlat, (tj + 1) * self.side)

    def images(self, ti: int, tj: int) -> Iterator[tuple[int, int, bool]]:
        """Where a tile shows up: column and row of its first cell, turned by half a circle or not."""
        x0, y0, x1, y1 = self.bounds(ti, tj)
        for turn in (-self.nlon, 0, self.nlon) if self.periodic else (0,):
            yield x0 + turn, y0, False
            if self.fold:
                yield self.nlon - x1 + turn, 2 * self.nlat - y1, True

    def reached(self, x: int, y: int, w: int, h: int, halo: int) -> Iterator[tuple[int, int]]:
        """Tiles whose halo meets a block."""
        last_i, last_j = (self.nlon - 1) // self.side, (self.nlat - 1) // self.side
        for ti in range(max(0, (x - halo) // self.side), min(last_i, (x + w - 1 + halo) // self.side) + 1):
            for tj in range(max(0, (y - halo) // self.side), min(last_j, (y + h - 1 + halo) // self.side) + 1):
                yield ti, tj


def tiled(field: DataFrame, raster: str, tiling: Tiling) -> DataFrame:
    """raster, ti, tj, cells and open (all zero) of a table of cells (raster, i, j, value)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0, x1, y1 = tiling.bounds(key[1], key[2])
        v = np.full((y1 - y0, x1 - x0), np.nan)
        v[pdf["j"].to_numpy() - 1 - y0, pdf["i"].to_numpy() - 1 - x0] = pdf["value"].to_numpy(dtype=float)
        return pd.DataFrame({"raster": [key[0]], "ti": key[1], "tj": key[2], "cells": [v.tobytes()], "open": [np.zeros(v.shape, dtype=np.uint8).tobytes()]})

    inside = (F.col("i") >= 1) & (F.col("i") <= tiling.nlon) & (F.col("j") >= 1) & (F.col("j") <= tiling.nlat)
    rows = field.where(inside & F.col(raster).isNotNull()).select(F.col(raster).cast("string").alias("raster"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value"))
    at = [F.floor((F.col(c) - 1) / tiling.side).cast("int").alias(t) for c, t in (("i", "ti"), ("j", "tj"))]
    return rows.withColumns(dict(zip(("ti", "tj"), at))).groupBy("raster", "ti", "tj").applyInPandas(build, _TILE)


def cells(tiles: DataFrame, raster: str, kind: str, tiling: Tiling) -> DataFrame:
    """raster, i, j and value of every cell of the tiles; ``kind`` is the type of the raster's name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ti, tj, v in zip(*(batch.column(c).to_pylist() for c in ("raster", "ti", "tj", "cells"))):
                x0, y0, x1, y1 = tiling.bounds(ti, tj)
                v = np.frombuffer(v)
                j, i = np.divmod(np.arange(len(v)), x1 - x0)
                yield pa.record_batch([pa.array([name] * len(v), pa.string()), pa.array((i + x0 + 1).astype(np.int32)), pa.array((j + y0 + 1).astype(np.int32)), pa.array(v, mask=np.isnan(v))], ["raster", "i", "j", "value"])

    return tiles.select("raster", "ti", "tj", "cells").mapInArrow(rows, "raster string, i int, j int, value double").select(F.col("raster").cast(kind).alias(raster), "i", "j", "value")


def sent(tiles: DataFrame, tiling: Tiling, halo: int) -> DataFrame:
    """For each tile the blocks that make up it and its halo; x and y are places in it, from the halo's corner."""
    if halo > min(tiling.nlon, tiling.nlat):
        raise ValueError("the halo is wider than the raster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ti, tj, v, o in zip(*(batch.column(c).to_pylist() for c in ("raster", "ti", "tj", "cells", "open"))):
                x0, y0, x1, y1 = tiling.bounds(ti, tj)
                shape = (y1 - y0, x1 - x0)
                layers = np.frombuffer(v).reshape(shape), np.frombuffer(o, dtype=np.uint8).reshape(shape)
                out: list[list] = [[] for _ in range(9)]
                for x, y, turned in tiling.images(ti, tj):
                    own = [a[::-1, ::-1] for a in layers] if turned else layers
                    for to_i, to_j in tiling.reached(x, y, shape[1], shape[0], halo):
                        a0, b0, a1, b1 = tiling.bounds(to_i, to_j)
                        left, low = max(x, a0 - halo), max(y, b0 - halo)
                        right, high = min(x + shape[1], a1 + halo), min(y + shape[0], b1 + halo)
                        if left < right and low < high:
                            part = [np.ascontiguousarray(a[low - y : high - y, left - x : right - x]).tobytes() for a in own]
                            for column, value in zip(out, (name, to_i, to_j, left - a0 + halo, low - b0 + halo, right - left, high - low, *part)):
                                column.append(value)
                kinds = [pa.string(), *[pa.int32()] * 6, pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in _BLOCK.split(", ")])

    return tiles.select("raster", "ti", "tj", "cells", "open").mapInArrow(run, _BLOCK)


def assembled(table: pa.Table, key: tuple, tiling: Tiling, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and open marks of a tile with its halo; nothing where there is no cell."""
    x0, y0, x1, y1 = tiling.bounds(key[1], key[2])
    v = np.full((y1 - y0 + 2 * halo, x1 - x0 + 2 * halo), np.nan)
    o = np.zeros(v.shape, dtype=bool)
    for x, y, w, h, own, marks in zip(*(table.column(c).to_pylist() for c in ("x", "y", "w", "h", "cells", "open"))):
        v[y : y + h, x : x + w] = np.frombuffer(own).reshape(h, w)
        o[y : y + h, x : x + w] = np.frombuffer(marks, dtype=np.uint8).reshape(h, w) > 0
    return v, o


def looked_around(tiles: DataFrame, tiling: Tiling, halo: int, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Tiles with what ``work`` makes of values and open marks with halo: those of the tile alone."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        name, ti, tj = (k.as_py() for k in key)
        v, o = work(*assembled(table, (name, ti, tj), tiling, halo))
        return pa.table([pa.array([name], pa.string()), pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([o.astype(np.uint8).tobytes()], pa.binary())], ["raster", "ti", "tj", "cells", "open"])

    return sent(tiles, tiling, halo).groupBy("raster", "ti", "tj").applyInArrow(run, _TILE)


def _squares(v: np.ndarray, halo: int, ri: int, rj: int) -> np.ndarray:
    """Sums over the (2 ri + 1) by (2 rj + 1) cells around each cell inside of the halo."""
    total = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
    np.cumsum(np.cumsum(v, axis=0), axis=1, out=total[1:, 1:])
    h, w = v.shape[0] - 2 * halo, v.shape[1] - 2 * halo
    at = lambda y, x: total[halo + y : halo + y + h, halo + x : halo + x + w]
    return at(rj + 1, ri + 1) - at(-rj, ri + 1) - at(rj + 1, -ri) + at(-rj, -ri)


def box_mean(field: DataFrame, raster: str, nlon: int, nlat: int, ri: int, rj: int, periodic: bool = True, side: int = SIDE) -> DataFrame:
    """``field`` (raster, i, j, value) with each value replaced by the mean of those at most ``ri`` columns and ``rj`` rows away; cells without a value don't count and stay so."""
    tiling = Tiling(nlon, nlat, side, periodic)
    halo = max(ri, rj)

    def work(v: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        had = ~np.isnan(v)
        own = slice(halo, v.shape[0] - halo), slice(halo, v.shape[1] - halo)
        total, n = _squares(np.where(had, v, 0.0), halo, ri, rj), _squares(had.astype(float), halo, ri, rj)
        return np.where(had[own], total / np.maximum(n, 1), np.nan), np.zeros(total.shape)

    out = looked_around(tiled(field, raster, tiling), tiling, halo, work)
    return cells(out, raster, field.schema[raster].dataType.simpleString(), tiling)


def fill_from_squares(field: DataFrame, raster: str, nlon: int, nlat: int, least: DataFrame, periodic: bool = True, side: int = SIDE) -> DataFrame:
    """``field`` with each value below the ``least`` (raster, least) of its raster replaced by the mean of those not below it in the smallest square around it that has any.

    Squares grow up to half of the raster's width; where none has any the value stays.
    All means are of the values as they came, whatever the order of cells.
    """
    tiling = Tiling(nlon, nlat, side, periodic)
    most = max(1, min((nlon - 1) // 2, nlat))
    marked = field.join(least, raster).withColumn("value", F.col("value"))
    # Values below the bound have a bit in the mark, those not below it none: both travel in one tile.
    low = tiled(marked.withColumn("value", F.when(F.col("value") < F.col("least"), F.col("value"))), raster, tiling).select("raster", "ti", "tj", F.col("cells").alias("low"))
    good = tiled(marked.withColumn("value", F.when(F.col("value") >= F.col("least"), F.col("value"))), raster, tiling)
    # A tile may have cells of one kind only.
    names = ["raster", "ti", "tj"]
    whole = good.select(*names, "cells").join(low, names, "full")

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ti, tj, v, lows in zip(*(batch.column(c).to_pylist() for c in (*names, "cells", "low"))):
                x0, y0, x1, y1 = tiling.bounds(ti, tj)
                none = np.full((y1 - y0) * (x1 - x0), np.nan)
                v, lows = (none if b is None else np.frombuffer(b) for b in (v, lows))
                open_ = ~np.isnan(lows)
                yield pa.record_batch([pa.array([name]), pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([np.where(open_, lows, v).tobytes()], pa.binary()), pa.array([open_.astype(np.uint8).tobytes()], pa.binary())], [*names, "cells", "open"])

    start = checkpointed(whole.mapInArrow(paired, _TILE))
    done, reach, tiles = None, 4, start
    while True:
        reach = min(reach, most)

        def work(v: np.ndarray, o: np.ndarray, reach: int = reach) -> tuple[np.ndarray, np.ndarray]:
            own = slice(reach, v.shape[0] - reach), slice(reach, v.shape[1] - reach)
            good = ~o & ~np.isnan(v)
            values, left = v[own].copy(), o[own].copy()
            for d in range(1, reach + 1):
                if not left.any():
                    break
                n = np.rint(_squares(good.astype(float), reach, d, d))
                hit = left & (n > 0)
                if hit.any():
                    values[hit] = (_squares(np.where(good, v, 0.0), reach, d, d) / np.maximum(n, 1))[hit]
                    left &= ~hit
            return values, left

        # Always from the values as they came: what is filled does not fill others.
        tiles = checkpointed(looked_around(start, tiling, reach, work))
        done = tiles
        if reach >= most or not tiles.where(F.instr(F.hex("open"), "01") > 0).take(1):
            break
        reach *= 4
    return cells(done, raster, field.schema[raster].dataType.simpleString(), tiling)


def fill_bounds(field: DataFrame, raster: str, most: float) -> DataFrame:
    """raster and least: of each raster the lower end of the hundredth that most values from 0.01 on lie in (ties: the least), and ``most`` at most; values from 1 on count with the last."""
    bins = field.where("value is not null").withColumn("_b", F.least(F.floor(F.col("value") * 100), F.lit(99).cast("long"))).where("_b >= 1")
    counts = bins.groupBy(raster, "_b").agg(F.count("*").alias("n"))
    best = counts.groupBy(raster).agg(F.max(F.struct("n", (-F.col("_b")).alias("b"))).alias("m"))
    every = field.select(raster).distinct().join(best, raster, "left")
    return every.select(raster, F.least(F.coalesce(-F.col("m.b"), F.lit(1).cast("long")) / 100, F.lit(most)).alias("least"))


def _relaxed(v: np.ndarray, o: np.ndarray, halo: int, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Values of the tile after ``steps``, its open marks, and how many of its cells moved in each step."""
    own = slice(halo, v.shape[0] - halo), slice(halo, v.shape[1] - halo)
    moved = []
    for _ in range(steps):
        around = np.full((v.shape[0] + 2, v.shape[1] + 2), np.nan)
        around[1:-1, 1:-1] = v
        sides = np.stack((around[1:-1, 2:], around[2:, 1:-1], around[1:-1, :-2], around[:-2, 1:-1]))
        n, total = (~np.isnan(sides)).sum(axis=0), np.nansum(sides, axis=0)
        had = ~np.isnan(v)
        before = np.where(had, v, 0.0)
        change = o & (n > 0)
        new = np.where(change, (total + n * before) / np.maximum(n * np.where(had, 2, 1), 1), v)
        going = change & (~had | (np.abs(before - np.where(change, new, before)) > tolerance * np.abs(before)))
        moved.append(int(going[own].sum()))
        v = new
    return np.ascontiguousarray(v[own]), o[own], moved


def relaxed_fill(field: DataFrame, raster: str, nlon: int, nlat: int, tolerance: float = 1e-4, most: int = 10_000, fold: bool = True, side: int = SIDE, strict: bool = True) -> DataFrame:
    """raster, i, j, value (1-based cells): cells without value become the mean of their neighbours, again and again until no change exceeds ``tolerance`` of a value.

    i is periodic; the first row stays; beyond the last row lies its mirror image
    (``fold``) or nothing. A raster that still changes after ``most`` steps is an
    error, or stays as it is then (``strict`` False). Cells that are not in ``field``
    have no value.
    """
    tiling = Tiling(nlon, nlat, side, True, fold)
    halo = max(1, min(STEPS, nlon, nlat))
    corners = field.select(raster).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(nlon), F.lit(side)))).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(nlat), F.lit(side))))
    # Every tile exists, also one without any value.
    rows = corners.select(raster, "i", "j", F.lit(None).cast("double").alias("value")).unionByName(field.select(raster, "i", "j", F.col("value").cast("double").alias("value"))).groupBy(raster, "i", "j").agg(F.max("value").alias("value"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for ti, tj, v in zip(*(batch.column(c).to_pylist() for c in ("ti", "tj", "cells"))):
                x0, y0, x1, y1 = tiling.bounds(ti, tj)
                o = np.isnan(np.frombuffer(v)).reshape(y1 - y0, x1 - x0)
                if y0 == 0:
                    o[0] = False
                marks.append(o.astype(np.uint8).tobytes())
            yield pa.record_batch([*(batch.column(c) for c in ("raster", "ti", "tj", "cells")), pa.array(marks, pa.binary())], ["raster", "ti", "tj", "cells", "open"])

    def advanced(tiles: DataFrame, steps: DataFrame | int) -> DataFrame:
        """``tiles`` after steps (a number, or raster and steps), with moved, the counts of each step."""

        fixed = steps if isinstance(steps, int) else None

        def run(key: tuple, table: pa.Table) -> pa.Table:
            name, ti, tj = (k.as_py() for k in key)
            n = fixed or table.column("steps")[0].as_py()
            v, o, moved = _relaxed(*assembled(table, (name, ti, tj), tiling, halo), halo, n, tolerance)
            return pa.table([pa.array([name], pa.string()), pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([o.astype(np.uint8).tobytes()], pa.binary()), pa.array([moved], pa.list_(pa.int32()))], ["raster", "ti", "tj", "cells", "open", "moved"])

        blocks = sent(tiles, tiling, halo)
        if fixed is None:
            blocks = blocks.join(steps, "raster")
        return blocks.groupBy("raster", "ti", "tj").applyInArrow(run, _TILE + ", moved array<int>")

    tiles = checkpointed(tiled(rows, raster, tiling).mapInArrow(opened, _TILE))
    finished, taken = [], 0
    while taken < most:
        n = min(halo, most - taken)
        new = checkpointed(advanced(tiles, n))
        counts = new.select("raster", F.posexplode("moved").alias("step", "n")).groupBy("raster", "step").agg(F.sum("n").alias("n"))
        stops = checkpointed(counts.where("n = 0").groupBy("raster").agg((F.min("step") + 1).alias("steps")))
        # What came to rest in this round ends with the step of its own.
        finished.append(checkpointed(advanced(tiles.join(stops.select("raster"), "raster", "left_semi"), stops)).drop("moved"))
        taken += n
        tiles = checkpointed(new.drop("moved").join(stops.select("raster"), "raster", "left_anti"))
        if not tiles.take(1):
            break
    else:
        if strict and tiles.take(1):
            raise ValueError(f"rasters still change after {most} steps")
        finished.append(tiles)
    out = finished[0]
    for x in finished[1:]:
        out = out.unionByName(x)
    return cells(out, raster, field.schema[raster].dataType.simpleString(), tiling)
