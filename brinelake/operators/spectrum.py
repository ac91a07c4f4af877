"""Sample blocks and their spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("context", "path")


def sample_blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows with their block and place: of repeated times the last row, n rows in a block, and only blocks after which n more rows came.

    Adds ``duration``, in seconds from the block's first time to the next block's.
    """
    once = rows.groupBy(*KEYS, "time").agg(F.max_by("value", "seq").alias("value"))
    w = Window.partitionBy(*KEYS).orderBy("time")
    placed = once.withColumn("__n", F.row_number().over(w) - 1).withColumn("__then", F.lead("time", n).over(w)).withColumn("__rest", F.lead("time", 2 * n - 1).over(w))
    blocks = placed.withColumn("block", F.floor(F.col("__n") / n).cast("long")).withColumn("place", F.col("__n") % n)
    seconds = (F.unix_micros(F.col("__then").cast("timestamp")) - F.unix_micros(F.col("time").cast("timestamp"))) / 1e6
    starts = blocks.where("place = 0 and __rest is not null").select(*KEYS, "block", F.col("time").alias("start"), seconds.alias("duration"))
    return blocks.join(starts, [*KEYS, "block"]).select(*KEYS, "block", "place", "time", "value", "start", "duration")


def bins(values: np.ndarray, duration: float, step: float) -> list[dict]:
    """Magnitude and phase of summed coefficients by frequency.

    A coefficient is added first, and then the bin closes if its frequency is beyond the bin's centre plus half
    a step; the first centre is 0, and the last open bin is dropped.
    """
    n = len(values)
    out, total, centre = [], 0j, 0.0
    for k, c in enumerate(np.fft.rfft(values)):
        total += c
        if k / duration > centre + step / 2:
            out.append({"magnitude": float(2 * abs(total) / n), "phase": float(np.angle(total))})
            total, centre = 0j, centre + step
    return out


def spectra(rows: DataFrame, n: int, step: float) -> DataFrame:
    """One row for each block: number_of_samples, frequency_step_size, duration, coefficients.

    The transform runs in Arrow batches over blocks gathered as arrays of n numbers, so a task holds a batch of blocks.
    """
    blocks = (
        sample_blocks(rows, n)
        .groupBy(*KEYS, "block", "start", "duration")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value")))).alias("s"))
        .select(*KEYS, "block", "start", "duration", F.transform("s", lambda x: x["value"]).alias("samples"))
    )

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("magnitude", pa.float64()), ("phase", pa.float64())]))
        for batch in batches:
            found = [bins(np.asarray(v, float), t, step) for v, t in zip(batch.column("samples").to_pylist(), batch.column("duration").to_pylist())]
            columns = [batch.column(c) for c in (*KEYS, "block", "start", "duration")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*KEYS, "block", "start", "duration", "coefficients"])

    types = {f.name: f.dataType.simpleString() for f in blocks.schema}
    head = ", ".join(f"{c} {types[c]}" for c in (*KEYS, "block", "start", "duration"))
    out = blocks.mapInArrow(run, f"{head}, coefficients array<struct<magnitude: double, phase: double>>")
    return out.withColumns({"number_of_samples": F.lit(n), "frequency_step_size": F.lit(step)})
