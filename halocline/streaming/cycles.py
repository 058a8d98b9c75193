"""Cycles with carried state: running super-observations in a state store, and analyses that start from the one before.

``running_superobs`` keeps count, mean and squared differences of every cell and
type in Spark's state store, one small row each, so a stream that stops and starts
again goes on where it was. Batches are summed up before they meet the state, in a
way that doesn't depend on how observations are dealt to batches.

``run_cycles`` analyses a stream of observations batch by batch. Each batch reads
the ensemble and the inflation that the one before left and writes its own beside
it, under the number of the batch: a batch that runs again after a failure reads the
same and writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.transform import inflation_field
from ..plans.analysis import analysis
from ..schema import FilterConfig

_STATE = "n long, mean double, squares double"
_OUT = "elem int, i int, j int, n long, dat double, err double"


class RunningCell(StatefulProcessor):
    """Count, mean and sum of squared differences of a cell; a batch's own three are merged into it."""

    def __init__(self, min_error: float, scale: float):
        self.min_error, self.scale = min_error, scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cell", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, squares = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        for pdf in rows:
            # Sorted: sums don't depend on the order of arrival within a batch.
            own = pdf["dat"].dropna().sort_values()
            if len(own):
                m = float(own.mean())
                apart, total = m - mean, n + len(own)
                squares += float(((own - m) ** 2).sum()) + apart**2 * n * len(own) / total
                mean += apart * len(own) / total
                n = total
        if n:
            self.state.update((n, mean, squares))
        if n > 1:
            yield pd.DataFrame({"elem": [key[0]], "i": [key[1]], "j": [key[2]], "n": [n], "dat": [mean], "err": [self.scale * (self.min_error + (squares / (n - 1)) ** 0.5)]})

    def close(self) -> None:
        pass


def running_superobs(stream: DataFrame, min_error: float, scale: float = 1.0) -> DataFrame:
    """elem, i, j, n, dat and err of each cell that a batch adds to, over all batches so far; cells of one observation wait for a second.

    ``stream`` has elem, i, j and dat. The session's state store must be RocksDB.
    """
    return stream.select(F.col("elem").cast("int").alias("elem"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("dat").cast("double").alias("dat")).groupBy("elem", "i", "j").transformWithStateInPandas(RunningCell(min_error, scale), _OUT, "Update", "None")


def use_state_store(spark: SparkSession) -> None:
    """The state store that keeps values of stateful processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def one_cycle(state: DataFrame, points: DataFrame, obs: DataFrame, config: FilterConfig) -> tuple[DataFrame, DataFrame]:
    """The ensemble after ``obs``, as the next cycle reads it (point, k, var, kmt, ens), and the points with the inflation that was used."""
    out = analysis(state, points, obs, config)
    used = points.drop("inflation").join(inflation_field(points, config), "point", "left")
    return out.select("point", "k", "var", "kmt", F.col("ana").alias("ens")), used


def run_cycles(
    stream: DataFrame,
    state: DataFrame,
    points: DataFrame,
    folder: str,
    checkpoint: str,
    config: FilterConfig = FilterConfig(),
    forecast: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Start the cycles of what has arrived: batch n reads ``folder``/state-(n-1) and points-(n-1), at first ``state`` and ``points`` (with kmt), and writes its own.

    ``forecast`` brings an analysis to the time of the next batch; without it the
    ensemble persists. A batch without observations passes everything on.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before, grid = state, points
        if number:
            before, grid = (spark.read.parquet(f"{folder}/{name}-{number - 1:06d}") for name in ("state", "points"))
            before = forecast(before) if forecast else before
        ensemble, used = one_cycle(before, grid, batch, config)
        ensemble.write.mode("overwrite").parquet(f"{folder}/state-{number:06d}")
        used.write.mode("overwrite").parquet(f"{folder}/points-{number:06d}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
