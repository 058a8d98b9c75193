"""Evaluating an expression once: Spark copies a column's expression into each later use of it, also into lambdas that run for each element."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def evaluated(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row: its expressions are not copied into what follows. Filters don't pass it, so filter before."""
    return df.select(F.explode(F.array(F.struct(*[df[c] for c in df.columns]))).alias("_row")).select("_row.*")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of spark.checkpoint.dir, so that what follows starts from there.

    Where that is unset, a local master gets a folder of its own; on a cluster it is an error.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; with a local master that has none, in the machine's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
