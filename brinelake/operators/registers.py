"""Modbus register and coil frames: decoding, deltas, faults, rules and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guarded import guarded

WRAP, LIMIT = 65535, 50000
ON = 65280  # the word of a coil that is on


def word(hex_text: Column, at: Column | int) -> Column:
    """The 16-bit word at a character place (from 1) of hex digits."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hex_text, at, F.lit(4)), 16, 10).cast("int")


def decode_header(frames: DataFrame, value: str = "value") -> DataFrame:
    """Adds slave, function_code, address, n and words; frames of seven bytes or fewer are dropped."""
    h = F.hex(F.col(value))
    ok = frames.where(F.length(value) > 7)
    count = F.floor((F.length(value) - 7) / 2).cast("int")
    # the digits are bound to a variable, or each word would make them anew
    words = F.get(F.transform(F.array(h), lambda x: F.transform(F.sequence(F.lit(0), count - 1), lambda i: word(x, i * 4 + 15))), F.lit(0))
    body = F.when(count > 0, words).otherwise(F.array().cast("array<int>"))
    return ok.select(
        "*",
        F.conv(F.substring(h, 1, 2), 16, 10).cast("int").alias("slave"),
        word(h, 3).alias("function_code"),
        word(h, 7).alias("address"),
        word(h, 11).alias("n"),
        body.alias("words"),
    )


def registers(frames: DataFrame) -> DataFrame:
    """One row for each register of decoded frames of functions 3 and 4: register, word."""
    rows = frames.where(F.col("function_code").isin(3, 4))
    out = rows.select("*", F.posexplode("words").alias("i", "word"))
    return out.withColumn("register", F.col("address") + F.col("i")).drop("i", "words")


def coils(frames: DataFrame) -> DataFrame:
    """One row for each coil of decoded frames of functions 1 and 2: coil, state."""
    rows = frames.where(F.col("function_code").isin(1, 2))
    out = rows.select("*", F.posexplode("words").alias("i", "word"))
    return out.select("*", (F.col("address") + F.col("i")).alias("coil"), (F.col("word") == ON).alias("state")).drop("i", "words", "word")


def faulty(words: Column) -> Column:
    """A sensor fault: any word 0x7FFF or 0x8000, or all words zero."""
    return F.exists(words, lambda w: w.isin(32767, 32768)) | F.forall(words, lambda w: w == 0)


def without_faults(frames: DataFrame) -> DataFrame:
    return frames.where(~(F.col("function_code").isin(3, 4) & faulty(F.col("words"))))


def deltas(rows: DataFrame) -> DataFrame:
    """Adds delta and time_delta (milliseconds) to register rows.

    The state of an address is its last word, whatever function read it.  A slave's first message has delta =
    word and no time delta; an address new on a known slave has the previous word 0 and a null time delta.
    """
    w = Window.partitionBy("connector", "slave", "register").orderBy("time", "seq")
    seen = rows.withColumn("__before", F.lag("word").over(w)).withColumn("__then", F.lag("time").over(w))
    # Each register's first row, of which there are few, tells the slave's first message.  Both branches read the same
    # exchange, so frames are scanned and decoded once, and no window has all rows of a slave.
    slave = Window.partitionBy("connector", "slave")
    is_first = F.struct("time", "seq") == F.min(F.struct("time", "seq")).over(slave)
    new = seen.where("__before is null").withColumn("__first", is_first)
    known = seen.where("__before is not null").withColumn("__first", F.lit(False))
    step = F.col("word") - F.coalesce("__before", F.lit(0))
    wrapped = F.when(F.col("__first"), F.col("word")).when(step < -LIMIT, step + WRAP).when(step > LIMIT, step - WRAP).otherwise(step)
    millis = F.when(F.col("__then").isNotNull(), F.expr("timestampdiff(MILLISECOND, __then, time)"))
    return known.unionByName(new).withColumn("delta", wrapped).withColumn("time_delta", millis).drop("__before", "__then", "__first")


def contained_rules(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """Frames with each rule of their slave and function whose registers are all inside the frame.

    ``rules``: slave, function_code, r_address, r_n, path and what else they hold.  They are configuration; the
    join has an equality part, and the ranges are a condition on what it finds.
    """
    inside = (F.col("r_address") >= F.col("address")) & (F.col("r_address") + F.col("r_n") <= F.col("address") + F.col("n"))
    return frames.join(rules, ["slave", "function_code"]).where(inside)


def at(address: Column | int, words: str = "words", first: str = "address") -> Column:
    """The word of a register by its address, null outside the frame."""
    return F.get(F.col(words), (F.lit(address) if isinstance(address, int) else address) - F.col(first))


def encode(slave: Column, function_code: Column, address: Column, values: Column) -> Column:
    """A write frame: header and big-endian words."""
    four = lambda x: F.lpad(F.hex(x), 4, "0")
    return F.unhex(F.concat(F.lpad(F.hex(slave), 2, "0"), four(function_code), four(address), four(F.size(values)), F.array_join(F.transform(values, four), "")))


def rule_results(frames: DataFrame, expression: str, *keep: str) -> DataFrame:
    """keep, value of frames for which a rule over their words has a result; one that fails or gives null has none."""
    value = guarded(frames, expression).value.cast("double")
    return frames.select(*keep, value.alias("value")).where("value is not null")


def write_frames(rows: DataFrame, values: Column) -> DataFrame:
    """Adds ``frame`` to rows with slave, function_code, address, n; null with a ``reason`` if the values don't fit."""
    reason = (
        F.when(values.isNull(), "no values")
        .when(F.size(values) != F.col("n"), "wrong number of values")
        .when(F.exists(values, lambda v: v.isNull() | (v < 0) | (v > 65535)), "value out of range")
    )
    frame = encode(F.col("slave"), F.col("function_code"), F.col("address"), values)
    return rows.withColumn("reason", reason).withColumn("frame", F.when(F.col("reason").isNull(), frame))


def coil_words(states: Column) -> Column:
    return F.transform(states, lambda s: F.when(s, ON).otherwise(0))
