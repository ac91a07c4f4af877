"""Reconciliation of two sites: what is missing, and which rows to send again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import bounds, first_period, in_closed_periods

FACTOR, MAX_PERIODS, LAG = 0.99, 500, "1 HOUR"


def compare_counts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """origin, start, local_count (0 if none), remote_count of remote periods within the local bounds."""
    # the bounds are one row
    inside = remote.join(F.broadcast(bounds(local)), F.col("start").between(F.col("first_start"), F.col("last_start"))).select("origin", "start", F.col("count").alias("remote_count"))
    return inside.join(local, ["origin", "start"], "left").select(
        "origin", "start", F.coalesce("count", F.lit(0)).alias("local_count"), "remote_count"
    )


def compare_counts_by_parts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The same as an inner join and, for what has no partner, an anti join, as a set."""
    inside = remote.join(F.broadcast(bounds(local)), F.col("start").between(F.col("first_start"), F.col("last_start"))).select("origin", "start", F.col("count").alias("remote_count"))
    keys = ["origin", "start"]
    both = inside.join(local, keys).select(*keys, F.col("count").alias("local_count"), "remote_count")
    alone = inside.join(local, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("local_count"), "remote_count")
    return both.unionByName(alone).distinct()


def count_requests(local: DataFrame, remote: DataFrame, asof: Column) -> DataFrame:
    """origin, start of all periods from an origin's first one to an hour before ``asof`` that remote doesn't have."""
    last = asof - F.expr(f"INTERVAL {LAG}")
    firsts = first_period(local).where(F.col("start") < last)
    series = firsts.select("origin", F.explode(F.sequence("start", last, F.expr("INTERVAL 5 MINUTES"))).alias("start")).where(F.col("start") < last)
    return series.join(remote, ["origin", "start"], "left_anti")


def incomplete(compared: DataFrame, factor: float = FACTOR) -> DataFrame:
    return compared.where(F.col("local_count") < F.col("remote_count") * factor)


def newest_periods(periods: DataFrame, most: int = MAX_PERIODS) -> DataFrame:
    """The newest ``most`` + 1 periods of each origin."""
    w = Window.partitionBy("origin").orderBy(F.desc("start"))
    return periods.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most + 1).drop("n")


def missing_stats(periods: DataFrame) -> DataFrame:
    return periods.groupBy("origin").agg(F.count("*").alias("periods"), F.max("start").alias("newest"), F.min("start").alias("oldest"))


def completeness(compared: DataFrame) -> DataFrame:
    return compared.withColumn("ratio", F.col("local_count") / F.col("remote_count"))


def resend_uuids(local: DataFrame, requested: DataFrame) -> DataFrame:
    """Local (origin, start, uuid, count) but those of which the requester already has as many rows."""
    l, r = local.alias("l"), requested.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("origin", "start", "uuid")]
    return l.join(r, [*same, F.col("l.count") <= F.col("r.count")], "left_anti")


def resend_rows(mapped: DataFrame, uuids: DataFrame, transfer_uuid: Column) -> DataFrame:
    """Rows of the uuids in their closed periods, stamped; a row in two asked periods is sent once."""
    keys = ["origin", "start", "uuid"]
    rows = in_closed_periods(mapped).join(uuids.select(*keys), keys, "left_semi").drop("start").distinct()
    return rows.withColumn("transfer_uuid", transfer_uuid)


def reconcile(local_rows: DataFrame, remote_rows: DataFrame, asof: Column, factor: float = FACTOR, most: int = MAX_PERIODS):
    """(count requests, incomplete periods, rows to send) for the site that has ``local_rows``."""
    from .rollup import period_counts, rows_per_uuid

    local, remote = period_counts(local_rows), period_counts(remote_rows)
    periods = newest_periods(incomplete(compare_counts(local, remote), factor), most)
    uuids = resend_uuids(rows_per_uuid(remote_rows, periods), rows_per_uuid(local_rows, periods))
    return count_requests(local, remote, asof), periods, resend_rows(remote_rows, uuids, F.lit("resend"))
