"""The local ensemble transform: normal equations summed where observations and points meet, solved once per point.

A point's transform needs only Y'WY (members x members), Y'Wd and a count, which
are sums over its observations. So no task ever holds a point's observations:
cubes of space are cut into blocks of bounded numbers of observations and of
points, each block pair adds up its sums in numpy, and the sums of a point are
added up as a stream before its eigenproblem is solved.

What is shuffled grows with a point's observations, up to triangles of symmetric
matrices: a block with few observations for a point sends these, weighted, instead
of their sums, and the transform of a point with few observations in all is a
multiple of the identity and a term for each of them.

One transform serves all levels of a point and all variables of a group: variables
whose weights of observation types are equal. Distances are found once for all
groups. With a mixed layer a column has two points, and surface observations count
for the upper one only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ensemble
from ..functions.geo import CUT_OFF, basin_mark
from ..schema import EARTH_RADIUS, OBS_TYPES, FilterConfig
from .spatial import cube, reached

#: Observations and points of a block: bounds what a task holds.
BLOCK_OBS, BLOCK_POINTS = 20_000, 2_000
#: Metres: cubes are no smaller, so that small radii neither copy observations nor make a group for each point.
LEAST_SIDE = 200_000.0
#: Fixed value: types that lie at a level; their distance to a point's level counts.
LEVELLED = ("sst", "sss", "u", "v", "t", "s")
#: The variable of layer thicknesses.
THICKNESS = "h"
#: Levels of a point that are transformed together, and points that are solved together.
LEVELS_AT_ONCE, SOLVED_AT_ONCE = 64, 64
#: Variables take no part in types of a lesser weight.
LEAST_WEIGHT = 1e-30
#: ``few`` observations as they are, weighted, in a (few x members) with their departures in b; where few is 0, a is the upper triangle of the sums.
_SUMS = "point long, grp int, n long, few int, a binary, b binary"
_KEY = ["c", "o", "g"]


def _xyz(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lo, la = np.radians(lon), np.radians(lat)
    return EARTH_RADIUS * np.stack((np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)), axis=1)


def _most(m: int) -> int:
    """Observations that take no more room than the sums over them, with ``m`` members."""
    return m // 2


def _triangle(a: np.ndarray) -> np.ndarray:
    return a[..., *np.triu_indices(a.shape[-1])]


def _square(triangle: np.ndarray, m: int) -> np.ndarray:
    out = np.empty((*triangle.shape[:-1], m, m))
    i, j = np.triu_indices(m)
    out[..., i, j] = out[..., j, i] = triangle
    return out


def _block_sums(config: FilterConfig):
    groups = [{OBS_TYPES[name]: w for name, w in row.items()} for row in config.variable_groups()[1]]

    def run(obs: pa.Table, points: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        if obs.num_rows and points.num_rows:
            take = lambda t, c: t.column(c).to_numpy().astype(np.float64)
            where = _xyz(take(obs, "lon"), take(obs, "lat"))
            olev, dep, err = take(obs, "lev"), take(obs, "dep"), take(obs, "err")
            elem = obs.column("elem").to_numpy()
            surface = np.isin(elem, [OBS_TYPES["sst"], OBS_TYPES["sss"]])
            # Types whose level counts; sea level and all others act on the whole column.
            levelled = np.isin(elem, [OBS_TYPES[name] for name in LEVELLED])
            pert = obs.column("pert").combine_chunks()
            y = pert.values.to_numpy(zero_copy_only=False)[pert.offsets[0].as_py() : pert.offsets[-1].as_py()].reshape(obs.num_rows, -1)
            at = _xyz(take(points, "lon"), take(points, "lat"))
            lat, lev = take(points, "lat"), take(points, "lev")
            own_basin, basin = obs.column("basin").to_numpy(), points.column("basin").to_numpy()
            upper = points.column("upper").to_numpy(zero_copy_only=False).astype(bool)
            weights = [np.array([row.get(e, 1.0) for e in elem.tolist()]) for row in groups]
            for i, name in enumerate(points.column("point").to_pylist()):
                sigma = (1.0 - abs(lat[i]) / 90.0) * (config.sigma_equator - config.sigma_pole) + config.sigma_pole
                dist = np.sqrt(((where - at[i]) ** 2).sum(axis=1))
                if config.metric == "great_circle":
                    dist = 2 * EARTH_RADIUS * np.arcsin(np.clip(dist / (2 * EARTH_RADIUS), 0, 1))
                use = dist <= CUT_OFF * sigma
                squares = (dist / sigma) ** 2
                if config.vertical_localisation:
                    apart = np.where(levelled, np.abs(olev - lev[i]), 0.0) / config.sigma_vertical
                    use &= apart <= CUT_OFF
                    squares = squares + apart**2
                if config.block_basins:
                    use &= own_basin * basin[i] != 2
                if not upper[i]:
                    use &= ~surface
                near = np.flatnonzero(use)
                decayed = np.exp(-0.5 * squares[near]) / err[near] ** 2
                for group, weight in enumerate(weights):
                    own = weight[near] >= LEAST_WEIGHT
                    k = near[own]
                    if len(k):
                        root = np.sqrt(decayed[own] * weight[k])
                        c, e, few = y[k] * root[:, None], dep[k] * root, len(k)
                        if few > _most(y.shape[1]):
                            c, e, few = _triangle(c.T @ c), c.T @ e, 0
                        for column, x in zip(out, (name, group, len(k), few, c.tobytes(), e.tobytes())):
                            column.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], ["point", "grp", "n", "few", "a", "b"])

    return run


def local_sums(points: DataFrame, obs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """point, grp, n, few, a, b: parts of the sums of each point and group of variables, one for each block of observations that has any within reach.

    ``points``: point, lon, lat, lev, upper. ``obs``: obs_id, elem, lon, lat, lev,
    dep, err, pert; rows with a null in these or err <= 0 are left out.
    """
    radius = CUT_OFF * max(config.sigma_equator, config.sigma_pole)
    side = max(radius, LEAST_SIDE)
    p = points.select("point", *[F.col(c).cast("double") for c in ("lon", "lat", "lev")], F.coalesce("upper", F.lit(True)).alias("upper")).where("point is not null and lon is not null and lat is not null")
    o = obs.select("obs_id", F.col("elem").cast("int").alias("elem"), *[F.col(c).cast("double") for c in ("lon", "lat", "lev", "dep", "err")], F.col("pert").cast("array<double>").alias("pert"))
    o = o.na.drop().where("err > 0")
    p, o = (x.withColumn("basin", basin_mark(F.col("lon"), F.col("lat"))) for x in (p, o))
    p = p.withColumn("c", cube(F.col("lon"), F.col("lat"), side))
    o = reached(o, "c", side, radius)
    # Numbers of blocks by cube: counts are aggregated before the shuffle; cubes without points or observations go here.
    blocks = o.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK_OBS)).alias("no")).join(p.groupBy("c").agg(F.ceil(F.count("*") / F.lit(BLOCK_POINTS)).alias("ng")), "c")
    spread = lambda df, key, own, own_n, other, other_n: (
        df.join(blocks, "c").withColumn(own, F.pmod(F.xxhash64(key), own_n)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), other_n - 1))).drop("no", "ng")
    )
    o = spread(o, "obs_id", "o", F.col("no"), "g", F.col("ng"))
    p = spread(p, "point", "g", F.col("ng"), "o", F.col("no"))
    return o.groupBy(*_KEY).cogroup(p.groupBy(*_KEY)).applyInArrow(_block_sums(config), _SUMS)


def transforms_of(a: np.ndarray, b: np.ndarray, inflation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point, from its summed normal equations, the symmetric root and the mean weights: columns of their sum are the weights of the analysis members."""
    m = b.shape[1]
    values, vectors = np.linalg.eigh(a + np.eye(m) * ((m - 1) / inflation)[:, None, None])
    turned = vectors.transpose(0, 2, 1)
    mean = vectors @ ((turned @ b[:, :, None]) / values[:, :, None])
    return (vectors * np.sqrt((m - 1) / values)[:, None, :]) @ turned, mean[:, :, 0]


def factors_of(c: np.ndarray, e: np.ndarray, inflation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``transforms_of``, from the weighted observations themselves (c, departures e): scale, change, axes and the mean weights; the root is scale x identity + axes' x change x axes."""
    m = c.shape[2]
    own = ((m - 1) / inflation)[:, None]
    left, size, axes = np.linalg.svd(c, full_matrices=False)
    values = size**2 + own
    turned = (left.transpose(0, 2, 1) @ e[:, :, None])[:, :, 0]
    mean = ((turned * size / values)[:, None, :] @ axes)[:, 0]
    scale = np.sqrt((m - 1) / own)
    return scale[:, 0], np.sqrt((m - 1) / values) - scale, axes, mean


def _packed(scale: float, change: np.ndarray, axes: np.ndarray, mean: np.ndarray) -> bytes:
    """A transform as bytes: members, number of axes, scale, changes, mean weights, axes. A whole root has -1 axes, and its upper triangle in their place."""
    whole = change is None
    return np.concatenate(([len(mean), -1 if whole else len(change), scale], () if whole else change, mean, axes.reshape(-1))).tobytes()


def _unpacked(trans: bytes) -> tuple[int, float, np.ndarray, np.ndarray, np.ndarray]:
    """Number of axes, scale, changes, mean weights, and axes or the whole root."""
    x = np.frombuffer(trans)
    m, n, scale = int(x[0]), int(x[1]), float(x[2])
    change, mean, rest = np.split(x[3:], (max(n, 0), max(n, 0) + m))
    return n, scale, change, mean, _square(rest, m) if n < 0 else rest.reshape(n, m)


def _expanded(trans: bytes) -> np.ndarray:
    """The matrix of a packed transform, row by row."""
    n, scale, change, mean, axes = _unpacked(trans)
    root = axes if n < 0 else np.eye(len(mean)) * scale + (axes.T * change) @ axes
    return (root + mean[:, None]).reshape(-1)


def _applied(x: np.ndarray, trans: bytes | list[float]) -> np.ndarray:
    """Rows of perturbations times a transform, packed or whole."""
    if not isinstance(trans, bytes):
        return x @ np.array(trans).reshape(x.shape[1], -1)
    n, scale, change, mean, axes = _unpacked(trans)
    turned = x @ axes if n < 0 else x * scale + ((x @ axes.T) * change) @ axes
    return turned + (x @ mean)[:, None]


class _Sums:
    """The sums of one point and group: weighted observations while these are few, their normal equations from then on."""

    def __init__(self, point: int, grp: int, inflation: float):
        self.key, self.inflation, self.n = (point, grp), inflation, 0
        self.c: list[np.ndarray] = []
        self.e: list[np.ndarray] = []
        self.few, self.a, self.b = 0, None, None

    def add(self, n: int, few: int, a: bytes, b: bytes) -> None:
        self.n += n
        a, b = np.frombuffer(a), np.frombuffer(b)
        if few:
            self.c.append(a.reshape(few, -1))
            self.e.append(b)
            self.few += few
            if self.few > _most(self.c[0].shape[1]):
                self._sum(0.0 if self.a is None else self.a, 0.0 if self.b is None else self.b)
        else:
            self._sum(a if self.a is None else self.a + a, b if self.b is None else self.b + b)

    def _sum(self, a: np.ndarray | float, b: np.ndarray | float) -> None:
        if self.few:
            c, e = np.concatenate(self.c), np.concatenate(self.e)
            a, b = a + _triangle(c.T @ c), b + c.T @ e
            self.c, self.e, self.few = [], [], 0
        self.a, self.b = a, b

    def finish(self) -> None:
        if self.a is not None:
            self._sum(self.a, self.b)


def _solved(points: list[_Sums]) -> list[bytes]:
    """The packed transforms of some points: those with as many observations are solved at once."""
    out: list[bytes] = [b""] * len(points)
    alike: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        p.finish()
        alike.setdefault(p.few, []).append(i)
    for few, own in alike.items():
        inflation = np.array([points[i].inflation for i in own])
        if few:
            c, e = (np.stack([np.concatenate(x) for x in parts]) for parts in ([points[i].c for i in own], [points[i].e for i in own]))
            rows = zip(*factors_of(c, e, inflation))
        else:
            b = np.stack([points[i].b for i in own])
            root, mean = transforms_of(_square(np.stack([points[i].a for i in own]), b.shape[1]), b, inflation)
            rows = ((0.0, None, x, w) for x, w in zip(_triangle(root), mean))
        for i, row in zip(own, rows):
            out[i] = _packed(*row)
    return out


def packed_transforms(points: DataFrame, obs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """As ``transforms``, with trans as bytes that ``analyse`` reads, in factors where a point has few observations.

    Where ``points`` have an inflation of their own, over 0, it replaces that of the settings.
    """
    if not config.inflation > 0:
        raise ValueError("inflation is over 0")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums arrive in the order of points: those of one point are added up, and some points are solved at once."""
        points: list[_Sums] = []

        def done() -> pa.RecordBatch:
            columns = ([p.key[0] for p in points], [p.key[1] for p in points], [p.n for p in points], _solved(points))
            points.clear()
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["point", "grp", "n_obs", "trans"])

        for batch in batches:
            for point, group, *part, factor in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not points or points[-1].key != (point, group):
                    if len(points) == SOLVED_AT_ONCE:
                        yield done()
                    points.append(_Sums(point, group, factor))
                points[-1].add(*part)
        if points:
            yield done()

    sums = local_sums(points, obs, config)
    own = F.lit(float(config.inflation))
    if "inflation" in points.columns:
        sums = sums.join(points.select("point", F.col("inflation").cast("double").alias("_own")), "point")
        own = F.when(F.col("_own") > 0, F.col("_own")).otherwise(own)
    sums = sums.select("point", "grp", "n", "few", "a", "b", own.alias("inflation"))
    return sums.repartition("point", "grp").sortWithinPartitions("point", "grp").mapInArrow(solve, "point long, grp int, n_obs long, trans binary")


def transforms(points: DataFrame, obs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """point, grp, n_obs and trans (members x members, row by row) of every point and group of variables that has an observation in reach."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_expanded(x) for x in batch.column("trans").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("point", "grp", "n_obs")), pa.array(rows, pa.list_(pa.float64()))], ["point", "grp", "n_obs", "trans"])

    return packed_transforms(points, obs, config).mapInArrow(unpack, "point long, grp int, n_obs long, trans array<double>")


def analyse(state: DataFrame, trans: DataFrame | None, config: FilterConfig = FilterConfig()) -> DataFrame:
    """``state`` (point, k, var, kmt, ens) with ana: the ensemble times the transform of its point and its variable's group.

    ``trans`` is of ``transforms`` or ``packed_transforms``. A point without
    observations gets sqrt(inflation) times its perturbations; if there is no
    observation at all the ensemble stays as it is (``trans`` None). Land
    (kmt < 1) has zeros. LEVELS_AT_ONCE levels of a point travel together with its
    transform, so a group is bounded by the number of variables. With additive
    inflation ``state`` has the draws of each row as well (addi, an array over
    members). All rows have the same number of members.
    """
    if config.additive and "addi" not in state.columns:
        raise ValueError("additive inflation needs the draws, addi")
    if trans is None:
        return state.select("point", "k", "var", "kmt", "ens", F.col("ens").alias("ana"))
    root = config.inflation**0.5
    addi = (F.col("addi") if config.additive else F.lit(None)).cast("array<double>").alias("addi")
    layer = F.floor(F.col("k") / LEVELS_AT_ONCE).alias("_layer")
    fields = [F.col("k").cast("int").alias("k"), F.col("var"), F.col("kmt").cast("int").alias("kmt"), F.col("ens").cast("array<double>").alias("ens"), addi]
    of = [F.lit(x) for pair in config.variable_groups()[0].items() for x in pair]
    group = F.coalesce(F.create_map(*of)[F.col("var")], F.lit(0)) if of else F.lit(0)
    rows = state.groupBy(F.col("point").cast("long").alias("point"), group.alias("grp"), layer).agg(F.collect_list(F.struct(*fields)).alias("rows"))
    joined = rows.join(trans.select("point", "grp", "trans"), ["point", "grp"], "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
            ens = flat.field("ens")
            x = ens.flatten().to_numpy().reshape(len(flat), -1)
            ana = x - x.mean(axis=1, keepdims=True)
            start = 0
            for n, t in zip(sizes.tolist(), batch.column("trans").to_pylist()):
                own = slice(start, start + n)
                ana[own] = ana[own] * root if t is None else _applied(ana[own], t)
                start += n
            ana += x.mean(axis=1, keepdims=True)
            kmt = flat.field("kmt")
            ana[kmt.fill_null(1).to_numpy(zero_copy_only=False) < 1] = 0.0
            starts = pa.array(np.arange(len(flat) + 1) * x.shape[1], pa.int32())
            points = batch.column("point").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.record_batch(
                [points, flat.field("k"), flat.field("var"), kmt, ens, pa.ListArray.from_arrays(starts, pa.array(ana.reshape(-1))), flat.field("addi")],
                ["point", "k", "var", "kmt", "ens", "ana", "addi"],
            )

    out = joined.select("point", "rows", "trans").mapInArrow(apply, "point long, k int, var string, kmt int, ens array<double>, ana array<double>, addi array<double>")
    return finished(out, config).drop("addi")


def finished(df: DataFrame, config: FilterConfig) -> DataFrame:
    """Relaxation, additive inflation and physical limits on ``ana``, and layer thicknesses as they were unless they are to be updated, given the background ``ens`` and the draws ``addi``; no draws (null) add nothing."""
    if config.rtpp and config.rtps:
        raise ValueError("relax perturbations or spread, not both")
    wet = F.coalesce(F.col("kmt") >= 1, F.lit(True))
    if config.rtpp:
        df = df.withColumn("ana", F.when(wet, ensemble.rtpp(F.col("ana"), F.col("ens"), config.rtpp)).otherwise(F.col("ana")))
    if config.rtps:
        df = df.withColumn("ana", F.when(wet, ensemble.rtps(F.col("ana"), F.col("ens"), config.rtps)).otherwise(F.col("ana")))
    if config.additive:
        df = df.withColumn("ana", F.when(wet & F.col("addi").isNotNull(), ensemble.additive(F.col("ana"), F.col("addi"), config.additive)).otherwise(F.col("ana")))
    if not config.update_thickness:
        df = df.withColumn("ana", F.when(F.col("var") == THICKNESS, F.col("ens")).otherwise(F.col("ana")))
    for var, (low, high) in config.physical_limits.items():
        held = F.transform("ana", lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))
        df = df.withColumn("ana", F.when((F.col("var") == var) & wet, held).otherwise(F.col("ana")))
    return df


def inflation_field(points: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """point and inflation as the next cycle reads it: what was used, and 0 on land (kmt < 1). The filter doesn't adapt it."""
    own = F.col("inflation").cast("double") if "inflation" in points.columns else F.lit(None).cast("double")
    used = F.when(own > 0, own).otherwise(F.lit(float(config.inflation)))
    return points.select("point", F.when(F.col("kmt") < 1, 0.0).otherwise(used).alias("inflation"))
