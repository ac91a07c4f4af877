"""Five-minute rollups and what is derived from them.

Counts have the columns start, origin, count.  All of these are aggregations with map-side
combining; only keys and counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD = "5 minutes"


def period_start(time: str | Column = "time") -> Column:
    return F.window(time, PERIOD)["start"]


def period_end(start: str | Column = "start") -> Column:
    return (F.col(start) if isinstance(start, str) else start) + F.expr("INTERVAL 5 MINUTES")


def period_counts(mapped: DataFrame) -> DataFrame:
    """Rows of each five-minute period and origin."""
    return mapped.groupBy(period_start().alias("start"), "origin").agg(F.count("*").alias("count"))


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Sum of the counts of several rollups."""
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy("start", "origin").agg(F.sum("count").alias("count"))


def first_period(counts: DataFrame) -> DataFrame:
    return counts.groupBy("origin").agg(F.min("start").alias("start"))


def earliest(counts: DataFrame, asof: Column) -> DataFrame:
    """One row: the first period of any origin, ``asof`` if there is none."""
    return counts.agg(F.coalesce(F.min("start"), asof).alias("start"))


def bounds(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"))


def in_closed_periods(mapped: DataFrame) -> DataFrame:
    """Each row once for every period [start, start + 5 min], both ends included, that its time is in."""
    begin = period_start()
    starts = F.when(F.col("time") == begin, F.array(begin, begin - F.expr("INTERVAL 5 MINUTES"))).otherwise(F.array(begin))
    return mapped.withColumn("start", F.explode(starts))


def rows_per_uuid(mapped: DataFrame, periods: DataFrame) -> DataFrame:
    """origin, start, uuid, count over the closed periods asked for in ``periods`` (origin, start)."""
    rows = in_closed_periods(mapped.select("origin", "time", "uuid"))
    return rows.join(periods.select("origin", "start").distinct(), ["origin", "start"], "left_semi").groupBy("origin", "start", "uuid").agg(
        F.count("*").alias("count")
    )


def look_up(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """Counts of the (origin, start) of ``keys``, 0 where there is none."""
    return keys.join(counts, ["origin", "start"], "left").select("origin", "start", F.coalesce("count", F.lit(0)).alias("count"))


def latest_counts(arrivals: DataFrame) -> DataFrame:
    """Of repeated (start, origin) the count that arrived last, by ``seq``."""
    return arrivals.groupBy("start", "origin").agg(F.max_by("count", "seq").alias("count"))


def transfer_counters(mapped: DataFrame) -> DataFrame:
    """One row: deltas, updates with a transfer uuid, distinct raw uuids and rows moved."""
    return mapped.agg(
        F.count_distinct("seq").alias("messages"),
        F.count("transfer_uuid").alias("transferred"),
        F.count_distinct("uuid").alias("uuids"),
        F.count("*").alias("records"),
    )


def observed_transfers(mapped: DataFrame, observation) -> DataFrame:
    """``mapped`` itself, whose write also counts rows, rows with a transfer uuid, and the newest time, without a scan of their own."""
    return mapped.observe(observation, F.count("*").alias("records"), F.count("transfer_uuid").alias("transferred"), F.max("time").alias("newest"))
