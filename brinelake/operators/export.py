"""Export jobs: batches, topics, text feeds and line-transport frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import checksum
from ..sources.staging import stored

MAGIC = "UdPbC\0"
#: Fixed values of the transport standard: talker identifiers and their group, whose address and port are settings.
TALKERS = {
    "AG": "NAVD",
    "AI": "TGTD",
    "AP": "NAVD",
    "BI": "MISC",
    "BN": "VDRD",
    "CD": "RCOM",
    "CR": "RCOM",
    "CS": "RCOM",
    "CT": "RCOM",
    "CV": "RCOM",
    "CX": "RCOM",
    "DF": "NAVD",
    "DU": "MISC",
    "EC": "NAVD",
    "EI": "NAVD",
    "EP": "RCOM",
    "ER": "MISC",
    "FD": "VDRD",
    "FE": "VDRD",
    "FR": "VDRD",
    "FS": "VDRD",
    "GA": "NAVD",
    "GL": "NAVD",
    "GN": "NAVD",
    "GP": "NAVD",
    "HC": "NAVD",
    "HD": "VDRD",
    "HE": "SATD",
    "HF": "NAVD",
    "HN": "SATD",
    "HS": "VDRD",
    "II": "MISC",
    "IN": "NAVD",
    "LC": "NAVD",
    "NL": "MISC",
    "RA": "TGTD",
    "RC": "MISC",
    "SD": "NAVD",
    "SG": "MISC",
    "SI": "MISC",
    "SS": "MISC",
    "TI": "SATD",
    "U0": "MISC",
    "U1": "MISC",
    "U2": "MISC",
    "U3": "MISC",
    "U4": "MISC",
    "U5": "MISC",
    "U6": "MISC",
    "U7": "MISC",
    "U8": "MISC",
    "U9": "MISC",
    "UP": "MISC",
    "VD": "NAVD",
    "VM": "NAVD",
    "VR": "MISC",
    "VW": "NAVD",
    "WD": "VDRD",
    "WI": "NAVD",
    "WL": "VDRD",
    "YX": "MISC",
    "ZA": "TIME",
    "ZC": "TIME",
    "ZQ": "TIME",
    "ZV": "TIME",
}


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Adds the place of each row, from 0, in the order of ``order``, without one task for all rows.

    Rows are range-partitioned and sorted; a row's place is its place in the partition and the sizes of the
    partitions before it, of which there is one number each.  The placed rows are written once and both read from there:
    two plans over the same exchange may draw different range bounds, and then sizes and places don't fit.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = sorted_rows.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")
    placed = stored(placed, "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def batches(rows: DataFrame, delta: Column, size: int, order: str = "seq") -> DataFrame:
    """batch, payload: deltas in order of arrival, ``size`` + 1 to a batch, as a JSON array of texts."""
    n = numbered(rows.select(order, delta.alias("delta")), [order])
    grouped = n.groupBy(F.floor(F.col("n") / (size + 1)).cast("long").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("n", "delta"))).alias("d"))
    return grouped.select("batch", F.concat(F.lit("["), F.array_join(F.transform("d", lambda e: e["delta"]), ","), F.lit("]")).alias("payload"))


def topics(rows: DataFrame, prefix: str) -> DataFrame:
    """topic, payload of each value: prefix and context, colons as underscores, points as slashes."""
    topic = F.translate(F.concat(F.lit(prefix + "/"), F.translate("context", ":", "_"), F.lit("/"), "path"), ".", "/")
    return rows.select("seq", topic.alias("topic"), F.to_json(F.struct("value")).alias("payload"))


def feed(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text, for a file or message sink."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def talker_table(spark, addresses: dict[str, tuple[str, int]]) -> DataFrame:
    """The routing table of the talkers whose group has an address."""
    rows = [(t, g, *addresses[g]) for t, g in TALKERS.items() if g in addresses]
    return spark.createDataFrame(rows, "talker string, target string, address string, port int")


def tag_block(destination: str = "", source: str = "", unix_seconds: Column | None = None, line: Column | None = None) -> Column:
    """The tag block of a line: its parts with commas, and their checksum; empty without parts."""
    parts = [F.lit(f"d:{destination}")] if destination else []
    parts += [F.lit(f"s:{source}")] if source else []
    parts += [F.concat(F.lit("c:"), unix_seconds.cast("string"))] if unix_seconds is not None else []
    parts += [F.concat(F.lit("n:"), line.cast("string"))] if line is not None else []
    if not parts:
        return F.lit("")
    text = F.concat_ws(",", *parts)
    return F.concat(F.lit("\\"), text, F.lit("*"), checksum(text), F.lit("\\"))


def line_frames(raw: DataFrame, talkers: DataFrame, destination: str = "", source: str = "", seconds: bool = True, count: bool = True) -> DataFrame:
    """seq, address, port, frame of every NMEA sentence with a known talker; the line counter runs from 0 to 999.

    ``raw``: seq, time, type, value (text).  ``talkers`` is the routing table, of a fixed size.
    """
    known = raw.where((F.col("type") == "nmea0183") & (F.length("value") >= 3)).withColumn("talker", F.substring("value", 2, 2))
    routed = known.join(F.broadcast(talkers), "talker")
    if count:
        routed = numbered(routed, ["seq"], "line").withColumn("line", F.col("line") % 1000)
    block = tag_block(destination, source, F.unix_seconds(F.col("time").cast("timestamp")) if seconds else None, F.col("line") if count else None)
    frame = F.concat(F.lit(MAGIC), block, F.col("value"), F.lit("\r\n"))
    return routed.select("seq", "address", "port", frame.alias("frame"))
