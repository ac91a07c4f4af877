"""Keyed upserts, the vessel registry, appends and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["time", "origin", "context", "connector", "path"]
#: Registry columns: path that feeds each, and where in the value it stands (a fixed list).
REGISTRY = {
    "mmsi": ("mmsi", "$"),
    "name": ("name", "$"),
    "callsignvhf": ("communication.callsignVhf", "$"),
    "eninumber": ("registrations.other.eni.registration", "$"),
    "length": ("design.length", "$.overall"),
    "beam": ("design.beam", "$"),
    "vesseltype": ("design.aisShipType", "$.description"),
}
NUMBERS = ("length", "beam")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by key: the value that came last, all other columns of the row that came first (by seq).

    Running it again over its own result and the same ``new`` changes nothing.
    """
    rest = [c for c in old.columns if c not in (*KEY, "value")]
    return (
        old.unionByName(new)
        .groupBy(*KEY)
        .agg(F.max_by("value", "seq").alias("value"), F.min_by(F.struct(*rest), "seq").alias("first"))
        .select(*KEY, "value", *[F.col("first")[c].alias(c) for c in rest])
    )


def split_by_context(mapped: DataFrame) -> DataFrame:
    """Adds the partition columns of the stored table: date, and whether the context is the origin."""
    return mapped.withColumn("date", F.to_date("time")).withColumn("own_context", F.col("context") == F.col("origin"))


def append(df: DataFrame, path: str) -> None:
    """Append to a table partitioned by date, sorted in files for pruning by key."""
    keys = [c for c in ("context", "path", "time") if c in df.columns]
    out = split_by_context(df) if {"context", "origin"} <= set(df.columns) else df.withColumn("date", F.to_date("time"))
    by = ["date", "own_context"] if "own_context" in out.columns else ["date"]
    out.sortWithinPartitions(*by, *keys).write.mode("append").partitionBy(*by).parquet(path)


def registry_updates(mapped: DataFrame) -> DataFrame:
    """context and the seven registry columns, each the last value of its path; ``value`` holds JSON text."""
    json = F.try_parse_json("value")

    def column(name: str) -> Column:
        path, at = REGISTRY[name]
        kind = "double" if name in NUMBERS else "string"
        value = F.when(F.col("path") == path, F.try_variant_get(json, at, kind))
        return F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(name)

    paths = [p for p, _ in REGISTRY.values()]
    return mapped.where(F.col("path").isin(paths)).groupBy("context").agg(*map(column, REGISTRY))


def merge_registry(old: DataFrame, updates: DataFrame) -> DataFrame:
    """New values replace old ones column by column; contexts of either side stay."""
    o, u = old.alias("o"), updates.alias("u")
    return o.join(u, "context", "full").select("context", *[F.coalesce(F.col(f"u.{c}"), F.col(f"o.{c}")).alias(c) for c in REGISTRY])


def backfill(registry: DataFrame, mapped: DataFrame, column: str, path: str) -> DataFrame:
    """Registry column set from the latest row of ``path``, where there is one."""
    found = mapped.where(F.col("path") == path).groupBy("context").agg(F.max_by("value", F.struct("time", "seq")).alias("__v"))
    return registry.join(found, "context", "left").withColumn(column, F.coalesce("__v", column)).drop("__v")


def retain(df: DataFrame, asof: Column, keep: str, time: str = "time") -> DataFrame:
    """Rows not older than ``keep`` (an interval) before ``asof``.

    Over a table partitioned by date the condition on date prunes directories.
    """
    limit = asof - F.expr(f"INTERVAL {keep}")
    out = df.where(F.col(time) >= limit)
    return out.where(F.col("date") >= F.to_date(limit)) if "date" in df.columns else out


def log_rows(df: DataFrame, time: Column, message: Column) -> DataFrame:
    """time, origin, message rows for the transfer log."""
    return df.select(time.alias("time"), "origin", F.to_json(message).alias("message"))
