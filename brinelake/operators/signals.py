"""CAN signals, packed sensor frames and tank calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import pgn


def bits(payload: Column, start: Column, size: Column, big_endian: Column, signed: Column) -> Column:
    """An integer of ``size`` bits (up to 63) at bit ``start`` of a payload of up to eight bytes.

    Little-endian signals count from the least bit of the first byte; big-endian ones start at their most
    significant bit, numbered inside its byte as usual.
    """
    h = F.rpad(F.hex(payload), 16, "0")
    little = F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(h, i, F.lit(2))), "")

    def extract(digits: Column, low: Column) -> Column:
        # two halves of 32 bits each, so that no step leaves the range of a long
        high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
        rest = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
        whole = F.shiftleft(high, 32).bitwiseOR(rest)
        return F.call_function("shiftrightunsigned", whole, low).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)

    # place of the lowest bit of a big-endian signal, counted from the end of eight bytes
    low = 64 - (F.floor(start / 8) * 8 + (7 - start % 8)) - size
    raw = F.when(big_endian, extract(h, low.cast("int"))).otherwise(extract(little, start))
    return F.when(signed & (raw >= F.call_function("shiftleft", F.lit(1).cast("long"), size - 1)), raw - F.call_function("shiftleft", F.lit(1).cast("long"), size)).otherwise(raw)


def decode_can(frames: DataFrame, signals: DataFrame, rules: DataFrame, j1939: bool = True) -> DataFrame:
    """Frames (can_id, payload, ...) with each of their signals in range: origin, name, path, value.

    ``signals``: can_id, origin, name, start_bit, size, big_endian, signed, factor, offset, min, max.
    ``rules``: origin, name, path and, optionally, exclude (array of values).  Both are configuration.
    With ``j1939`` ids are compared by parameter group.
    """
    key = (lambda c: pgn(c)) if j1939 else (lambda c: c)
    table = signals.join(rules, ["origin", "name"]).withColumn("__key", key(F.col("can_id"))).drop("can_id")
    rows = frames.withColumn("__key", key(F.col("can_id").bitwiseAND(0x1FFFFFFF))).join(table, "__key").drop("__key")
    raw = bits(F.col("payload"), F.col("start_bit"), F.col("size"), F.col("big_endian"), F.col("signed"))
    value = raw * F.col("factor") + F.col("offset")
    out = rows.withColumn("value", value).where(F.col("value").between(F.col("min"), F.col("max")))
    if "exclude" in rules.columns:
        out = out.where(F.col("exclude").isNull() | ~F.array_contains("exclude", F.col("value")))
    return out.drop("start_bit", "size", "big_endian", "signed", "factor", "offset", "min", "max", "exclude")


def unpack_channels(frames: DataFrame, value: str = "value") -> DataFrame:
    """channel, word of frames of 18 bytes: six channels of three bytes that carry 6, 6 and 4 bits.

    Frames of another length, or whose first byte hasn't both top bits set, are dropped.
    """
    h = F.hex(F.col(value))
    byte = lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")
    ok = frames.where((F.length(value) == 18) & (byte(F.lit(1)).bitwiseAND(192) == 192))
    word = lambda c: (
        byte(c * 6 + 1).bitwiseAND(63) * 1024 + byte(c * 6 + 3).bitwiseAND(63) * 16 + F.shiftright(byte(c * 6 + 5).bitwiseAND(60), 2)
    )
    rest = [c for c in frames.columns if c != value]
    return ok.select(*rest, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(5)), word)).alias("channel", "word"))


def calibration_intervals(table: DataFrame) -> DataFrame:
    """lo, hi, v0, v1 of a calibration table (tank, height, volume); the last interval has no end."""
    w = Window.partitionBy("tank").orderBy("height")
    return table.select(
        "tank", F.col("height").alias("lo"), F.lead("height").over(w).alias("hi"), F.col("volume").alias("v0"), F.lead("volume").over(w).alias("v1"), F.row_number().over(w).alias("n")
    )


def invalid_tables(table: DataFrame) -> DataFrame:
    """Tanks whose heights or volumes, in the order given by ``n``, don't increase strictly."""
    w = Window.partitionBy("tank").orderBy("n")
    bad = (F.col("height") <= F.lag("height").over(w)) | (F.col("volume") <= F.lag("volume").over(w)) | F.col("height").isNull() | F.col("volume").isNull()
    return table.withColumn("bad", bad).where("bad").select("tank").distinct()


def volumes(readings: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``volume`` by linear interpolation: 0 below the table, the last volume above it; ``sensor_offset`` adds to the height.

    The table has few rows for a tank; they are gathered into one array for each tank, so that the join has
    one row of a tank and no range condition.
    """
    steps = calibration_intervals(table).groupBy("tank").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "v0", "v1"))).alias("steps"))
    height = F.col("height") + F.coalesce(F.col("sensor_offset"), F.lit(0.0))
    inside = lambda h: lambda s: (h >= s["lo"]) & (s["hi"].isNull() | (h < s["hi"]))
    between = lambda h: lambda s: F.when(s["hi"].isNull(), s["v0"]).otherwise(s["v0"] + (h - s["lo"]) * (s["v1"] - s["v0"]) / (s["hi"] - s["lo"]))
    # at most one interval holds the height, which is computed once
    found = F.flatten(F.transform(F.array(height), lambda h: F.transform(F.filter("steps", inside(h)), between(h))))
    volume = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(0.0))
    return readings.join(steps, "tank").withColumn("volume", F.when(F.col("height").isNotNull(), volume)).drop("steps")
