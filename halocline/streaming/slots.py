"""Observations that arrive as a stream: time slots, super-observations and cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def event_time(stream: DataFrame, time: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with time zone; the session's zone is UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def slot_superobs(stream: DataFrame, slot: str = "1 day", late: str = "6 hours", time: str = "ts") -> DataFrame:
    """n, mean and sample variance by slot, type and cell (i, j): the state is one row a group, kept until its slot is over by ``late``."""
    rows = event_time(stream, time).withWatermark(time, late)
    out = rows.groupBy(F.window(time, slot).alias("slot"), "elem", "i", "j").agg(F.count("dat").alias("n"), F.avg("dat").alias("dat"), F.var_samp("dat").alias("var"))
    return out.select(F.col("slot.start").alias("slot_start"), "elem", "i", "j", "n", "dat", "var")


def in_slot(stream: DataFrame, centre: str, hours: float, time: str = "ts") -> DataFrame:
    """Rows within ``hours`` of a slot's centre."""
    apart = F.unix_timestamp(F.col(time).cast("timestamp")) - F.unix_timestamp(F.lit(centre).cast("timestamp"))
    return stream.where(F.abs(apart) <= F.lit(hours * 3600.0))


def cycle(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``step`` on each batch of observations in turn; a step reads the last analysis and writes the next, so that it may run again after a failure."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
