"""Observations, grids and states derived from the driver's tables by fixed formulas, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ensemble
from ..functions.steps import evaluated


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in (("signup", 3073), ("error", 5521), ("click", 5525), ("view", 5522), ("purchase", 5351)) for x in pair])
    return e.select(
        F.col("event_id").alias("obs_id"),
        kind[F.col("event_type")].alias("elem"),
        ((F.col("user_id") * 37) % 360).cast("double").alias("lon"),
        ((F.col("user_id") * 13) % 121 - 60).cast("double").alias("lat"),
        ((F.col("event_id") % 40) * 10).cast("double").alias("lev"),
        F.col("value").alias("dat"),
        (1.0 + (F.col("event_id") % 5) * 0.5).alias("err"),
        F.dayofmonth("ts").alias("slot"),
        "ts",
        F.get_json_object("props", "$.k").cast("int").alias("flags"),
    )


OBS = """obs AS (SELECT event_id AS obs_id,
  CASE event_type WHEN 'signup' THEN 3073 WHEN 'error' THEN 5521 WHEN 'click' THEN 5525 WHEN 'view' THEN 5522 WHEN 'purchase' THEN 5351 END AS elem,
  ((user_id * 37) % 360)::DOUBLE AS lon, ((user_id * 13) % 121 - 60)::DOUBLE AS lat, ((event_id % 40) * 10)::DOUBLE AS lev,
  value AS dat, 1.0::DOUBLE + (event_id % 5) * 0.5::DOUBLE AS err, day(ts) AS slot, ts, json_extract_string(props, '$.k')::INT AS flags FROM events)"""


def _pick(x: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (x + 1).cast("int"))


def ensemble_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A member value for each of 64 dimensions of every embedding."""
    e = evaluated(read(spark, sf_dir, "embeddings").withColumn("hx", F.transform("embedding", lambda x: x.cast("double"))))
    mean = ensemble.mean(F.col("hx"))
    v = F.col("vec_id")
    out = e.select(
        v.alias("obs_id"),
        _pick(F.col("label") % 5, [3073, 5521, 5522, 5526, 5351]).alias("elem"),
        ((v * 37) % 360).cast("double").alias("lon"),
        ((v * 13) % 131 - 65).cast("double").alias("lat"),
        F.lit(0.0).alias("lev"),
        (F.when(F.col("label") % 5 == 2, 35.0).otherwise(0.0) + mean + ((v % 7) - 3) * 0.05).alias("dat"),
        F.when(F.col("label") % 5 == 2, 20.0).otherwise(0.1 + (v % 5) * 0.05).alias("err"),
        "hx",
        F.transform("hx", lambda x: F.when((v % 11 == 0) & (x > 0.2), 0).otherwise(1)).alias("qc_members"),
    )
    return evaluated(out)


ENS = """ens0 AS (SELECT vec_id AS v, label, list_transform(embedding, lambda x: x::DOUBLE) AS hx FROM embeddings),
ens AS (SELECT v AS obs_id, CASE label % 5 WHEN 0 THEN 3073 WHEN 1 THEN 5521 WHEN 2 THEN 5522 WHEN 3 THEN 5526 ELSE 5351 END AS elem,
  ((v * 37) % 360)::DOUBLE AS lon, ((v * 13) % 131 - 65)::DOUBLE AS lat, 0.0::DOUBLE AS lev,
  CASE WHEN label % 5 = 2 THEN 35.0::DOUBLE ELSE 0.0::DOUBLE END + list_sum(hx) / len(hx) + ((v % 7) - 3) * 0.05::DOUBLE AS dat,
  CASE WHEN label % 5 = 2 THEN 20.0::DOUBLE ELSE 0.1::DOUBLE + (v % 5) * 0.05::DOUBLE END AS err, hx,
  list_transform(hx, lambda x: CASE WHEN v % 11 = 0 AND x > 0.2 THEN 0 ELSE 1 END) AS qc_members FROM ens0)"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 36 x 18 field with cells 10 degrees wide: i, j (1-based), ij, lon, lat (centres), kmt, value."""
    c = read(spark, sf_dir, "customer")
    cells = c.groupBy((F.col("c_custkey") % 648).alias("n")).agg(F.avg("c_acctbal").alias("value"))
    i, j = F.col("n") % 36, F.floor(F.col("n") / 36)
    return cells.select((F.col("n") + 1).alias("ij"), (i + 1).cast("int").alias("i"), (j + 1).cast("int").alias("j"), (i * 10.0 + 5.0).alias("lon"), (j * 10.0 - 85.0).alias("lat"), (F.col("n") % 4).cast("int").alias("kmt"), "value")


FIELD = """field AS (SELECT n + 1 AS ij, (n % 36 + 1)::INT AS i, (n // 36 + 1)::INT AS j, (n % 36) * 10.0::DOUBLE + 5.0 AS lon, (n // 36) * 10.0::DOUBLE - 85.0 AS lat,
  (n % 4)::INT AS kmt, value FROM (SELECT c_custkey % 648 AS n, avg(c_acctbal) AS value FROM customer GROUP BY 1))"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points from nations: point, lon, lat, kmt."""
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(k.cast("long").alias("point"), (k * 14.4).alias("lon"), (k * 4.0 - 48.0).alias("lat"), (k % 4).alias("kmt"))


STATIONS = "stations AS (SELECT n_nationkey::BIGINT AS point, n_nationkey * 14.4::DOUBLE AS lon, n_nationkey * 4.0::DOUBLE - 48.0 AS lat, n_nationkey % 4 AS kmt FROM nation)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows: member (1 to 7), ij, k, var, value, as means over order lines."""
    x = read(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_linenumber").alias("member"), (F.col("l_orderkey") % 500).alias("ij"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("k"), F.col("l_returnflag").alias("var")).agg(F.avg("l_quantity").alias("value"))


MEMBERS = "members AS (SELECT l_linenumber AS member, l_orderkey % 500 AS ij, (l_suppkey % 4 + 1)::INT AS k, l_returnflag AS var, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature profiles: orders, with levels by line number (mean over lines that share one); every ninth level has no value."""
    x = read(spark, sf_dir, "lineitem")
    lines = x.groupBy(F.col("l_orderkey").alias("profile"), F.col("l_linenumber").alias("level")).agg(F.avg("l_quantity").alias("q"))
    gone = (F.col("profile") + F.col("level")) % 9 == 0
    return lines.select("profile", "level", (F.col("level") * 10.0).alias("depth"), F.when(~gone, F.col("q")).alias("value"))


PROFILES = """profiles AS (SELECT profile, level, level * 10.0::DOUBLE AS depth, CASE WHEN (profile + level) % 9 <> 0 THEN q END AS value
  FROM (SELECT l_orderkey AS profile, l_linenumber AS level, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2))"""
