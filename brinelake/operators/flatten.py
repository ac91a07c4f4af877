"""Deltas and rows: flattening, rebuilding, merging inside an update, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A delta: context, origin and updates, each with a source, a time and path/value pairs (values as JSON text).
SOURCE = "label STRING, type STRING, uuid STRING, transferUuid STRING"
DELTA = (
    f"context STRING, origin STRING, updates ARRAY<STRUCT<source STRUCT<{SOURCE.replace(' STRING', ': STRING')}>, "
    "timestamp: TIMESTAMP_NTZ, values: ARRAY<STRUCT<path: STRING, value: STRING>>>>"
).replace("source STRUCT", "source: STRUCT")


def flatten(deltas: DataFrame, *keep: str) -> DataFrame:
    """One row for each value of each update, with the places of both; columns of ``keep`` stay."""
    updates = deltas.select(*keep, "context", "origin", F.posexplode("updates").alias("update_no", "u"))
    values = updates.select("*", F.posexplode("u.values").alias("value_no", "v"))
    return values.select(
        *keep,
        F.col("u.timestamp").alias("time"),
        F.col("u.source.label").alias("connector"),
        F.col("u.source.type").alias("type"),
        "context",
        "origin",
        F.col("v.path").alias("path"),
        F.col("v.value").alias("value"),
        F.col("u.source.uuid").alias("uuid"),
        F.col("u.source.transferUuid").alias("transfer_uuid"),
        "update_no",
        "value_no",
    )


def rebuild(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row as a delta of one update with one value."""
    source = F.struct(F.col("connector").alias("label"), "type", "uuid", F.col("transfer_uuid").alias("transferUuid"))
    update = F.struct(source.alias("source"), F.col("time").alias("timestamp"), F.array(F.struct("path", "value")).alias("values"))
    return rows.select(*keep, "context", "origin", F.array(update).alias("updates"))


def rebuild_grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of one key as one delta, its updates and values in the order that flattening gave them."""
    source = F.struct(F.col("connector").alias("label"), "type", "uuid", F.col("transfer_uuid").alias("transferUuid"))
    values = rows.groupBy(*by, "context", "origin", "update_no", source.alias("source"), F.col("time").alias("timestamp")).agg(
        F.array_sort(F.collect_list(F.struct("value_no", "path", "value"))).alias("vs")
    )
    update = F.struct(
        "update_no", "source", "timestamp", F.transform("vs", lambda v: F.struct(v["path"].alias("path"), v["value"].alias("value"))).alias("values")
    )
    out = values.groupBy(*by, "context", "origin").agg(F.array_sort(F.collect_list(update), _by_number).alias("us"))
    return out.select(
        *by, "context", "origin", F.transform("us", lambda u: F.struct(u["source"].alias("source"), u["timestamp"].alias("timestamp"), u["values"].alias("values"))).alias("updates")
    )


def _by_number(a, b):
    return F.when(a["update_no"] < b["update_no"], -1).when(a["update_no"] > b["update_no"], 1).otherwise(0)


def list_kind(value: Column) -> Column:
    """The element type of a JSON list, null for anything else; objects are notifications, and so is what an empty list has."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    element = F.substring(kind, F.lit(7), F.length(kind) - 7)
    element = F.when(element.startswith("OBJECT") | (element == "VOID"), "OBJECT").otherwise(element)
    return F.when(kind.startswith("ARRAY<"), F.regexp_replace(element, r"^DECIMAL.*$|^DOUBLE$", "NUMBER"))


def merge_same_path(rows: DataFrame, key: list[str]) -> DataFrame:
    """One value (JSON text) for each (key, path), folded in the order of value_no.

    A value replaces the one before it, but a list after a list with the same type of elements is appended to it.  So only what follows
    the last replacement counts: places of replacements are numbered by a running sum, and the last number's values are
    joined.  The merged value's place is that of the last.
    """
    order = Window.partitionBy(*key, "path").orderBy("value_no")
    typed = rows.withColumn("__kind", list_kind(F.col("value")))
    replaces = F.coalesce(F.col("__kind") != F.lag("__kind").over(order), F.lit(True))
    parts = typed.withColumn("__replaces", replaces.cast("int")).withColumn("__part", F.sum("__replaces").over(order))
    inner = F.btrim(F.expr("substring(btrim(value), 2, length(btrim(value)) - 2)"))
    grouped = parts.groupBy(*key, "path").agg(
        F.max("value_no").alias("value_no"),
        F.max_by(F.struct("value", "__kind", "__part"), "value_no").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("__kind").isNotNull(), F.struct("value_no", "__part", inner.alias("x"))))).alias("lists"),
    )
    own = F.filter("lists", lambda e: (e["__part"] == F.col("last.__part")) & (e["x"] != ""))
    joined = F.concat(F.lit("["), F.array_join(F.transform(own, lambda e: e["x"]), ","), F.lit("]"))
    return grouped.select(*key, "path", "value_no", F.when(F.col("last.__kind").isNotNull(), joined).otherwise(F.col("last.value")).alias("value"))


def with_updates(deltas: DataFrame) -> DataFrame:
    """Deltas that have any update."""
    return deltas.where(F.size("updates") > 0)


def without_overwritten(rows: DataFrame, derived: DataFrame, message: str) -> DataFrame:
    """Rows but those of a message whose path the message's derived rows have."""
    return rows.join(derived.select(message, "path").distinct(), [message, "path"], "left_anti")


def same_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same (path, value) rows, in any order and as often; source and time don't count."""
    left, right = a.select("path", "value"), b.select("path", "value")
    odd = left.exceptAll(right).unionByName(right.exceptAll(left))
    return odd.agg((F.count("*") == 0).alias("equal"))
