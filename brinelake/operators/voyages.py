"""Legs, voyages and level events: islands of a moving flag or of level changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH = 6371008.8


def great_circle(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """Metres between two places in degrees."""
    a = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def legs(rows: DataFrame, moving: Column) -> DataFrame:
    """context, leg, moving, start, end, seconds, distance of maximal runs; distance is the trapezoid integral of ``speed`` inside the run."""
    w = Window.partitionBy("context").orderBy("time", "seq")
    flagged = rows.withColumn("moving", F.coalesce(moving, F.lit(False)))
    changed = (F.col("moving") != F.lag("moving").over(w)).cast("int")
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    step = (micros - F.lag(micros).over(w)) / 1e6
    inside = F.lag("moving").over(w) == F.col("moving")
    piece = F.when(inside, step * (F.col("speed") + F.lag("speed").over(w)) / 2).otherwise(0.0)
    marked = flagged.withColumn("piece", piece).withColumn("change", F.coalesce(changed, F.lit(0)))
    numbered = marked.withColumn("leg", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("context", "leg", "moving").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.sum("piece").alias("distance"))
    seconds = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6
    return out.withColumn("seconds", seconds)


def voyages(legs_: DataFrame, longest_stop: float) -> DataFrame:
    """context, voyage, start, end, legs: moving legs with stops of at most ``longest_stop`` seconds between them."""
    w = Window.partitionBy("context").orderBy("start")
    sailing = legs_.where("moving").withColumn("before", F.lag("end").over(w))
    pause = (F.unix_micros(F.col("start").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6
    first = F.when(F.col("before").isNull() | (pause > longest_stop), 1).otherwise(0)
    numbered = sailing.withColumn("first", first).withColumn("voyage", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("context", "voyage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("legs"))


def level_events(rows: DataFrame, threshold: float) -> DataFrame:
    """context, path, time, delta where a level differs from the one before by the threshold or more."""
    w = Window.partitionBy("context", "path").orderBy("time", "seq")
    return rows.withColumn("delta", F.col("value") - F.lag("value").over(w)).where(F.abs("delta") >= threshold).select("context", "path", "time", "seq", "delta")
