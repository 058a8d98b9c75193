"""The whole analysis: check observations, localise, transform, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ensemble
from ..operators.quality_control import ensemble_check
from ..operators.transform import analyse, packed_transforms
from ..schema import FilterConfig
from ..sources.decoders import merge_members


def analysis(state: DataFrame, points: DataFrame, obs: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """``state`` (point, k, var, kmt, ens) after the observations (with hx of every member): ens and ana.

    Without any accepted observation the ensemble stays as it is. With a mixed
    layer ``points`` have ``mixed``, the last level in it: a column has a point
    for levels up to it (all levels where it is null) and one for those below.
    """
    good = ensemble_check(obs, config).where("qc = 1")
    if good.isEmpty():
        return analyse(state, None, config)
    if not config.mixed_layer:
        return analyse(state, packed_transforms(points, good, config), config)
    of = lambda upper: 2 * F.col("point") + upper.cast("long")
    layers = points.withColumn("upper", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("point", of(F.col("upper"))).drop("mixed")
    own = state.join(points.select("point", "mixed"), "point", "left").withColumn("point", of(F.coalesce(F.col("k") <= F.col("mixed"), F.lit(True)))).drop("mixed")
    return analyse(own, packed_transforms(layers, good, config), config).withColumn("point", F.shiftright("point", 1))


def statistics(ana: DataFrame) -> DataFrame:
    """Mean, spread and increment of each row of an analysis."""
    a, b = F.col("ana"), F.col("ens")
    return ana.select("point", "k", "var", ensemble.mean(a).alias("mean"), ensemble.spread(a).alias("spread"), (ensemble.mean(a) - ensemble.mean(b)).alias("increment"))


def analysis_of_slots(state: DataFrame, points: DataFrame, records: DataFrame, config: FilterConfig = FilterConfig(), slots: list[int] | None = None) -> DataFrame:
    """``analysis`` with the observations of several time slots, each compared with the ensemble at its own time.

    ``records`` are those of all slots and members (slot, rid, member, elem, lon,
    lat, lev, dat, err, ohx, oqc); ``slots`` chooses some, None takes all. Records
    are told apart by slot and number, so the same number in two slots is two
    observations, and the files of all slots are merged in one pass.
    """
    rows = records if slots is None else records.where(F.col("slot").isin(slots))
    obs = merge_members(rows).withColumn("obs_id", F.col("slot").cast("long") * (1 << 40) + F.col("rid"))
    return analysis(state, points, obs, config)
