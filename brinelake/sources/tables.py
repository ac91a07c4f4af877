"""Reads over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("time", "connector", "type", "context", "origin", "path", "value", "uuid", "transfer_uuid")


def scan(mapped: DataFrame, where: Column, names: tuple[str, ...] = ("mmsi", "name")) -> DataFrame:
    """The nine columns of rows that fulfil ``where``; paths of vessel information are returned as empty."""
    path = F.when(F.col("path").isin(*names), F.lit("")).otherwise(F.col("path")).alias("path")
    return mapped.where(where).select(*[path if c == "path" else F.col(c) for c in COLUMNS])


def raw_lookup(raw: DataFrame, uuid: str | None = None) -> DataFrame:
    """Raw rows of one uuid, or all of them."""
    return raw if not uuid else raw.where(F.col("uuid") == uuid)


def union_view(own: DataFrame, other: DataFrame) -> DataFrame:
    """The two split tables as one."""
    return own.unionByName(other)


def fan_in(*feeds: DataFrame) -> DataFrame:
    """Several feeds as one; works on batch and streaming DataFrames alike."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out
