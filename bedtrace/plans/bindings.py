"""How the generic operators are bound to the given tables, on the Spark side and in SQL.

``events`` plays the log: group ``user_id``, depth ``x`` (hours since the start of 2024), signal ``sig`` (null for
``error`` events), the first 30 % of rows are the known prefix. ``lineitem`` plays a second log (by supplier) and the
seed tracks (by part); ``embeddings`` plays the spatial bank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedtrace.operators.cells import index_rows

EPOCH_2024_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "event_type",
        ((micros - EPOCH_2024_US) / F.lit(float(HOUR_US))).alias("x"),
        "value",
        F.when(F.col("event_type") != "error", F.col("value")).alias("sig"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = index_rows(events(spark, sf_dir), ["user_id"], ["x", "event_id"], "x", count="n_rows")
    return log.withColumn("known", F.col("row_idx") * 10 < F.col("n_rows") * 3)


EVENTS_SQL = f"""ev AS (
  SELECT user_id, event_id, event_type, (epoch_us(ts) - {EPOCH_2024_US}) / CAST({HOUR_US} AS DOUBLE) AS x, value,
         CASE WHEN event_type <> 'error' THEN value END AS sig
  FROM events),
seq AS (
  SELECT *, row_idx * 10 < n_rows * 3 AS known FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) - 1 AS BIGINT) AS row_idx,
           CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n_rows
    FROM ev))"""


def part_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments of a supplier in shipping order; ``x`` counts days."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("well"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(24.0 * HOUR_US)).alias("x"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
    )
    log = index_rows(li, ["well"], ["x", "l_orderkey", "l_linenumber"], "x", count="n_rows")
    return log.withColumn("known", F.col("row_idx") * 10 < F.col("n_rows") * 3)


PARTS_SQL = f"""li AS (
  SELECT l_suppkey AS well, epoch_us(l_shipdate) / CAST({24 * HOUR_US} AS DOUBLE) AS x, l_orderkey, l_linenumber,
         l_extendedprice AS price, l_quantity AS qty, l_discount AS disc
  FROM lineitem),
plog AS (
  SELECT *, row_idx * 10 < n_rows * 3 AS known FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY well ORDER BY x, l_orderkey, l_linenumber) - 1 AS BIGINT) AS row_idx,
           CAST(count(*) OVER (PARTITION BY well) AS BIGINT) AS n_rows
    FROM li))"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial points: x, y, value z and the owner."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pid"),
        F.col("label").alias("owner"),
        e[0].cast("double").alias("px"),
        e[1].cast("double").alias("py"),
        e[2].cast("double").alias("pz"),
    )


BANK_SQL = """bank AS (
  SELECT vec_id AS pid, label AS owner, CAST(embedding[1] AS DOUBLE) AS px, CAST(embedding[2] AS DOUBLE) AS py,
         CAST(embedding[3] AS DOUBLE) AS pz
  FROM embeddings)"""
