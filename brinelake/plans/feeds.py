"""Adapters from the driver tables to telemetry rows, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mapped`` rows from ``events``; time stays a timestamp without zone, as in the table."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    origin = F.concat(F.lit("v"), F.col("user_id") % 10)
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("c"), k % 3).alias("connector"),
        F.lit("signalk").alias("type"),
        F.when(k < 80, origin).otherwise(F.concat(F.lit("v"), 100 + F.col("user_id") % 50)).alias("context"),
        origin.alias("origin"),
        F.col("event_type").alias("path"),
        F.col("value"),
        F.concat(F.lit("u"), F.expr("event_id div 3")).alias("uuid"),
        F.lit(None).cast("string").alias("transfer_uuid"),
    )


#: ``mapped`` for DuckDB, to stand at the start of a WITH list.
MAPPED = """mapped AS (
  SELECT ts AS time, event_id AS seq, 'c' || (k % 3) AS connector, 'signalk' AS type,
         CASE WHEN k < 80 THEN origin ELSE 'v' || (100 + user_id % 50) END AS context,
         origin, event_type AS path, value, 'u' || (event_id // 3) AS uuid,
         CAST(NULL AS VARCHAR) AS transfer_uuid
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, 'v' || (user_id % 10) AS origin
        FROM events))"""
