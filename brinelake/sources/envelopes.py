"""Readers of message envelopes: raw messages, deltas, single values, batches and lines.

Each takes a DataFrame with a text column ``value``, batch or streaming, and returns rows with a ``reason``
that is null where the row could be read; ``rules.quarantine`` splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = ("connector", "timestamp", "type", "uuid", "value")
SINGLE = ("context", "origin", "path", "value", "timestamp")
_DELTA = (
    "context STRING, origin STRING, updates ARRAY<STRUCT<source: STRUCT<label: STRING, type: STRING, uuid: STRING, transferUuid: STRING>, "
    "timestamp: STRING, values: ARRAY<STRUCT<path: STRING, value: VARIANT>>>>"
)


def _missing(variant: Column, keys: tuple[str, ...]) -> Column:
    """Reason for the first key that isn't there."""
    return F.coalesce(*[F.when(F.try_variant_get(variant, f"$.{k}", "variant").isNull(), F.lit(f"{k} is missing")) for k in keys], F.lit(None).cast("string"))


def raw_messages(texts: DataFrame) -> DataFrame:
    """time, connector, type, uuid, value (binary), reason; all five keys must be texts, the value in base64."""
    v = F.col("__v")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    time = F.try_to_timestamp(get("timestamp"))
    body = F.when(get("value").rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(get("value")) % 4 == 0), get("value"))
    reason = (
        F.when(v.isNull(), "no JSON")
        .when(_missing(v, RAW).isNotNull(), _missing(v, RAW))
        .when(time.isNull(), "timestamp is no time")
        .when(body.isNull(), "value is no base64")
    )
    rows = texts.withColumn("__v", F.try_parse_json("value"))
    return rows.select(time.alias("time"), get("connector").alias("connector"), get("type").alias("type"), get("uuid").alias("uuid"), F.unbase64(body).alias("value"), reason.alias("reason"))


def delta_messages(texts: DataFrame) -> DataFrame:
    """context, origin, updates (values as variants), reason."""
    d = F.from_json("value", _DELTA)
    bad = F.exists("d.updates", lambda u: F.exists(u["values"], lambda v: v["path"].isNull() | v["value"].isNull()))
    reason = F.when(F.try_parse_json("value").isNull(), "no JSON").when(F.col("d.context").isNull(), "context is missing").when(bad, "path or value is missing")
    return texts.withColumn("d", d).select("d.context", "d.origin", "d.updates", reason.alias("reason"))


def single_values(texts: DataFrame) -> DataFrame:
    """time, context, origin, path, value (JSON text), connector, type, uuid, transfer_uuid, reason."""
    v = F.col("__v")
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    time = F.try_to_timestamp(get("timestamp"))
    reason = F.when(v.isNull(), "no JSON").when(_missing(v, (*SINGLE, "source")).isNotNull(), _missing(v, (*SINGLE, "source"))).when(time.isNull(), "timestamp is no time")
    rows = texts.withColumn("__v", F.try_parse_json("value"))
    return rows.select(
        time.alias("time"),
        get("context").alias("context"),
        get("origin").alias("origin"),
        get("path").alias("path"),
        F.to_json(F.try_variant_get(v, "$.value", "variant")).alias("value"),
        get("source.label").alias("connector"),
        get("source.type").alias("type"),
        get("source.uuid").alias("uuid"),
        get("source.transferUuid").alias("transfer_uuid"),
        reason.alias("reason"),
    )


def batch_messages(texts: DataFrame) -> DataFrame:
    """One delta for each element of each JSON array, with the numbers of its updates and of those that were transferred."""
    d = F.explode(F.from_json("value", f"ARRAY<STRUCT<{_fields()}>>"))
    rows = texts.select(d.alias("d")).select("d.context", "d.origin", "d.updates")
    transferred = F.size(F.filter("updates", lambda u: u["source"]["transferUuid"].isNotNull()))
    return rows.withColumns({"n_updates": F.size("updates"), "n_transferred": transferred})


def _fields() -> str:
    return _DELTA.replace("context STRING", "context: STRING").replace("origin STRING", "origin: STRING").replace("updates ARRAY", "updates: ARRAY")


def lines(spark: SparkSession, path: str, connector: str, kind: str, stream: bool = False) -> DataFrame:
    """Each line of text files as a raw row, stamped when it is read."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(
        F.current_timestamp().alias("time"), F.lit(connector).alias("connector"), F.lit(kind).alias("type"), F.expr("uuid()").alias("uuid"), F.col("value").cast("binary").alias("value")
    )


def write_raw(rows: DataFrame) -> DataFrame:
    """The text form of raw rows."""
    time = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select(F.to_json(F.struct("connector", time.alias("timestamp"), "type", "uuid", F.base64("value").alias("value"))).alias("value"))
