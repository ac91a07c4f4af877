"""Shapes of values, and rewrites of paths and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes in the order in which they are tried, and the keys each may have (fixed values).
SHAPES = {
    "position": ("altitude", "latitude", "longitude"),
    "vesselInfo": ("mmsi", "name"),
    "vesselType": ("id", "description"),
    "length": ("overall", "hull", "waterline"),
    "notification": ("state", "message"),
    "draft": ("current", "currentPort", "currentStarboard"),
    "spectrum": ("numberOfSamples", "frequencyStepSize", "duration", "coefficients"),
    "vector3d": ("x", "y", "z"),
}


def shape_of(value: Column) -> Column:
    """Name of the first shape that has all keys of a JSON value; integer, number, text, flag or notifications otherwise, else null."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    keys = F.json_object_keys(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    out = out.when(kind.isin("BIGINT"), "integer").when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "number").when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag")
    # a list of notifications: each element has no other keys
    inner = F.from_json(value, "array<string>")
    out = out.when(
        kind.startswith("ARRAY"),
        F.when(F.forall(inner, lambda e: F.size(F.array_except(F.json_object_keys(e), F.array(*map(F.lit, SHAPES["notification"])))) == 0), "notifications"),
    )
    for name, allowed in SHAPES.items():
        out = out.when(kind.startswith("OBJECT") & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0), name)
    return out


def storage_path(path: Column, value: Column) -> Column:
    """The empty path of vessel information as ``name`` if it has no mmsi, else ``mmsi``."""
    mmsi = F.get_json_object(value, "$.mmsi")
    return F.when(path == "", F.when(mmsi.isNull(), "name").otherwise("mmsi")).otherwise(path)


def json_scalar(value: Column) -> Column:
    """A string as a JSON text."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def from_json_scalar(value: Column) -> Column:
    """The string of a JSON text; other values as they are."""
    return F.coalesce(F.when(value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string")), value)


def pivot_object(rows: DataFrame, by: list[str], path: str, fields: list[str]) -> DataFrame:
    """Scalar rows ``path.field`` of each key as one JSON object without nulls; other rows stay as they are."""
    paths = [f"{path}.{f}" for f in fields]
    parts = rows.where(F.col("path").isin(paths))
    values = [F.max(F.when(F.col("path") == p, F.col("value").try_cast("double"))).alias(f) for p, f in zip(paths, fields)]
    objects = parts.groupBy(*by).agg(*values).select(*by, F.lit(path).alias("path"), F.to_json(F.struct(*fields)).alias("value"))
    rest = rows.where(~F.col("path").isin(paths)).select(*by, "path", F.col("value").cast("string").alias("value"))
    return rest.unionByName(objects)


def unpivot_object(rows: DataFrame, by: list[str], path: str, fields: list[str]) -> DataFrame:
    """The inverse: one row for each field that is there, as a set; other rows stay."""
    here = F.col("path") == path
    cells = F.array(*[F.struct(F.lit(f"{path}.{f}").alias("path"), F.get_json_object("value", f"$.{f}").alias("value")) for f in fields])
    parts = rows.where(here).select(*by, F.explode(cells).alias("c")).select(*by, "c.path", "c.value").where("value is not null").distinct()
    return rows.where(~here).select(*by, "path", "value").unionByName(parts)


def pack_message(df: DataFrame, *keep: str) -> DataFrame:
    """Log columns as a JSON message: period start and end, and counts with -1 for what is missing."""
    message = F.to_json(
        F.struct(
            F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
            F.date_format(F.col("start") + F.expr("INTERVAL 5 MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("end"),
            F.coalesce("local_count", F.lit(-1)).alias("local"),
            F.coalesce("remote_count", F.lit(-1)).alias("remote"),
        )
    )
    return df.select(*keep, message.alias("message"))


def unpack_message(df: DataFrame, *keep: str) -> DataFrame:
    m = F.from_json("message", "start string, local bigint, remote bigint")
    return df.select(*keep, m.alias("m")).select(
        *keep,
        F.to_timestamp_ntz("m.start").alias("start"),
        F.when(F.col("m.local") >= 0, F.col("m.local")).alias("local_count"),
        F.when(F.col("m.remote") >= 0, F.col("m.remote")).alias("remote_count"),
    )


def quote_paths(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Values of text paths as JSON strings, all others as they are."""
    return rows.withColumn("value", F.when(F.col("path").isin(paths), json_scalar(F.col("value"))).otherwise(F.col("value")))


def unquote_paths(rows: DataFrame, paths: list[str]) -> DataFrame:
    return rows.withColumn("value", F.when(F.col("path").isin(paths), from_json_scalar(F.col("value"))).otherwise(F.col("value")))


def key_to_array(key: Column) -> Column:
    return F.split(key, r"\.")


def array_to_key(parts: Column) -> Column:
    return F.array_join(parts, ".")


def wrap_info(rows: DataFrame) -> DataFrame:
    """Rows on ``name`` and ``mmsi`` as objects of one field on the empty path."""
    here = F.col("path").isin("name", "mmsi")
    wrapped = F.when(F.col("path") == "name", F.to_json(F.struct(F.col("value").alias("name")))).otherwise(F.to_json(F.struct(F.col("value").alias("mmsi"))))
    return rows.withColumns({"value": F.when(here, wrapped).otherwise(F.col("value")), "path": F.when(here, "").otherwise(F.col("path"))})


def unwrap_info(rows: DataFrame) -> DataFrame:
    mmsi, name = F.get_json_object("value", "$.mmsi"), F.get_json_object("value", "$.name")
    here = F.col("path") == ""
    name_of = F.when(mmsi.isNull(), "name").otherwise("mmsi")
    return rows.withColumns({"path": F.when(here, name_of).otherwise(F.col("path")), "value": F.when(here, F.coalesce(mmsi, name)).otherwise(F.col("value"))})
