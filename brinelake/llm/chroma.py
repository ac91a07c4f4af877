"""Chroma audio fingerprints: integral-image filters over pitch-class frames, and their alignment.

Samples are cut into overlapping frames; the spectrum of a frame is folded into twelve pitch classes and
normalised.  Filters of several shapes compare the sums of rectangles of the (frames x classes) image,
read from its integral image at every frame; each filter's value is quantised to two bits in Gray code, and
sixteen of them make one packed 32-bit integer for each frame.

Two recordings are aligned by the histogram of frame offsets at which their integers agree; the best offset is
confirmed by the bit error rate of all frames that overlap there.  Query integers meet the catalogue's in one
equi-join, and offsets are counted by aggregation, so no recording is compared with all others; recordings
with the same integers are aligned once for all of them.  All places of an integer count.  Places in a row are one run: what two
runs add to the histogram rises, stays and falls in straight lines, so that four changes of slope stand for all of their places.

Cases: null or too short recordings have no integers and no alignment; a silent frame has equal classes; rows
that repeat an id and its samples count once when aligned; equal histogram peaks take the least offset.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

RATE, FRAME, HOP = 8000, 1024, 256
LOW, HIGH = 60.0, 3600.0
#: Filters (shape, first class, classes, frames) and the limits of their four levels; together 16 x 2 bits.
FILTERS = tuple((shape, y, h, w) for shape, h, w in ((0, 3, 8), (1, 4, 4), (2, 4, 8), (3, 3, 6)) for y in (0, 3, 6, 8))
LEVELS = (-0.25, 0.0, 0.25)
WIDTH = max(w for *_, w in FILTERS)
GRAY = (0, 1, 3, 2)
#: Least places that agree at the best offset, and the greatest share of wrong bits, of an alignment.
LEAST_AGREE, BIT_ERRORS = 4, 0.35
#: Parts that the runs of one integer are dealt to; every searching run goes to all of them.
PARTS = 8


def pitch_classes(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) normalised energies."""
    n = 1 + (len(samples) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, 12))
    at = np.arange(FRAME)[None, :] + HOP * np.arange(n)[:, None]
    power = np.abs(np.fft.rfft(samples[at] * np.hanning(FRAME), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.flatnonzero((hertz >= LOW) & (hertz <= HIGH))
    classes = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), classes] = 1
    out = power[:, used] @ fold
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(norm > 1e-9, out / np.maximum(norm, 1e-9), 1 / np.sqrt(12))


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One unsigned 32-bit integer for each frame at which all filters fit."""
    image = pitch_classes(samples, rate)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(0).cumsum(1)
    x = np.arange(n)

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        return total[x + x1, y1] - total[x + x0, y1] - total[x + x1, y0] + total[x + x0, y0]

    out = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        h = min(h, 12 - y)
        if shape == 0:  # all against nothing
            a, b = box(0, w, y, y + h), np.full(n, 0.28 * w * h)
        elif shape == 1:  # upper classes against lower ones
            a, b = box(0, w, y, y + h // 2), box(0, w, y + h // 2, y + h)
        elif shape == 2:  # earlier frames against later ones
            a, b = box(0, w // 2, y, y + h), box(w // 2, w, y, y + h)
        else:  # the middle third of time against the outer thirds
            a, b = box(w // 3, 2 * w // 3, y, y + h), (box(0, w // 3, y, y + h) + box(2 * w // 3, w, y, y + h)) / 2
        level = np.searchsorted(LEVELS, np.log((1 + a) / (1 + b)), side="right")
        out = (out << np.uint32(2)) | np.asarray(GRAY, np.uint32)[level]
    return out


def fingerprints(recordings: DataFrame, id_col: str, samples_col: str, rate: int = RATE) -> DataFrame:
    """id, prints (array of integers, unsigned values as longs) for each row; ``samples_col`` holds arrays of numbers."""
    id_type = recordings.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 64):
            prints = []
            for samples in batch.column("samples"):
                values = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.empty(0)
                prints.append(fingerprint(np.nan_to_num(values.astype(float)), rate).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.list_(pa.int64()))], names=["id", "prints"])

    rows = recordings.select(F.col(id_col).alias("id"), F.col(samples_col).cast("array<float>").alias("samples"))
    return rows.mapInArrow(run, f"id {id_type}, prints array<long>").withColumnRenamed("id", id_col)


def _runs(prints):
    """(p, at, n): each integer, its first place and how often it stands in a row."""
    starts = F.filter(F.sequence(F.lit(0), F.size(prints) - 1), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))
    run = lambda s: F.transform(
        s, lambda at, k: F.struct(F.get(prints, at).alias("p"), at.alias("at"), (F.coalesce(F.get(s, k + 1), F.size(prints)) - at).alias("n"))
    )
    return F.flatten(F.transform(F.array(starts), run))


def align(prints: DataFrame, is_query, id_col: str, least: int = LEAST_AGREE, errors: float = BIT_ERRORS) -> DataFrame:
    """query, match_class, n_members, offset, n_agree, bit_error: each query row with each class of recordings that it aligns with.

    Recordings with the same integers are one class, named by its least id, and are aligned once; a query's own
    class counts if it has other members.  ``is_query`` is a condition on the column ``id``.
    """
    rows = prints.where(F.col(id_col).isNotNull() & (F.size("prints") > 0)).select(F.col(id_col).alias("id"), "prints").distinct()
    rows = materialize(rows.withColumn("key", F.sha2(F.to_json("prints").cast("binary"), 256)), "recordings")
    classes = rows.groupBy("key").agg(
        F.min("id").alias("name"), F.count_distinct("id").alias("n_members"), F.max(is_query).alias("asked"), F.first("prints").alias("prints")
    )
    classes = materialize(classes, "classes")
    part = lambda row: F.pmod(F.xxhash64(row), F.lit(PARTS))  # noqa: E731  a common integer's runs are dealt to several tasks
    runs = classes.select("name", "asked", F.explode(_runs(F.col("prints"))).alias("r")).select("name", "asked", "r.*")
    asked = runs.where("asked").select(F.col("name").alias("q"), "p", F.col("at").alias("q_at"), F.col("n").alias("q_n"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    met = asked.join(runs.select(F.col("name").alias("m"), "p", "at", "n", part("name").alias("part")), ["p", "part"]).where("q <> m")
    first = F.col("at") - F.col("q_at") - F.col("q_n") + 1  # the least offset at which the two runs meet
    changes = [(first, 1), (first + F.col("q_n"), -1), (first + F.col("n"), -1), (first + F.col("q_n") + F.col("n"), 1)]
    change = F.explode(F.array(*[F.struct(o.cast("long").alias("offset"), F.lit(c).cast("long").alias("change")) for o, c in changes])).alias("c")
    slopes = met.select("q", "m", change).groupBy("q", "m", "c.offset").agg(F.sum("c.change").alias("change")).where("change <> 0")
    w = Window.partitionBy("q", "m").orderBy("offset")
    slopes = slopes.withColumn("slope", F.sum("change").over(w)).withColumn("next", F.lead("offset").over(w))
    # the count at the last offset that has this slope
    peaks = slopes.withColumn("n", F.sum(F.col("slope") * (F.col("next") - F.col("offset"))).over(w)).where((F.col("slope") > 0) & (F.col("n") >= least))
    best = peaks.groupBy("q", "m").agg(F.max(F.struct("n", (1 - F.col("next")).alias("o"))).alias("b"))
    best = best.select("q", "m", (-F.col("b.o")).cast("int").alias("offset"), F.col("b.n").alias("n_agree"))
    pair = best.join(classes.select(F.col("name").alias("q"), F.col("prints").alias("qp")), "q").join(
        classes.select(F.col("name").alias("m"), F.col("prints").alias("mp"), "n_members"), "m"
    )
    first = F.greatest(F.lit(0), -F.col("offset"))
    n = F.least(F.size("qp") - first, F.size("mp") - (first + F.col("offset")))
    wrong = F.aggregate(
        F.zip_with(F.slice("qp", first + 1, n), F.slice("mp", first + F.col("offset") + 1, n), lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.lit(0),
        lambda s, x: s + x,
    )
    found = pair.select("q", F.col("m").alias("match_class"), "n_members", "offset", F.col("n_agree").cast("long").alias("n_agree"), (wrong / (32.0 * n)).alias("bit_error"))
    same = classes.where("asked and n_members > 1").select(
        F.col("name").alias("q"), F.col("name").alias("match_class"), "n_members", F.lit(0).alias("offset"), F.size("prints").cast("long").alias("n_agree"), F.lit(0.0).alias("bit_error")
    )
    found = found.where(F.col("bit_error") <= errors).unionByName(same)
    queries = rows.where(is_query).select(F.col("id").alias("query"), "key").join(classes.select("key", F.col("name").alias("q")), "key")
    return queries.join(found, "q").select("query", "match_class", "n_members", "offset", "n_agree", "bit_error")


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", note: int = 512, rate: int = RATE) -> DataFrame:
    """id, samples: each vector played as a tune, four values a chord, for tables that hold no audio."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        t = np.arange(note) / rate
        for batch in slices(batches, 64):
            out = []
            for v in batch.column("v").to_pylist():
                v = np.nan_to_num(np.asarray([x if x is not None else 0.0 for x in v or ()], float))
                v = v[: len(v) // 4 * 4].reshape(-1, 4)
                hertz = 220.0 * 2 ** (np.clip(np.round(6 * v), -12, 24) / 12 + np.arange(4) / 4)
                out.append(np.sin(2 * np.pi * hertz[:, :, None] * t).sum(1).ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tolist() for x in out], pa.list_(pa.float32()))], names=["id", "samples"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, f"id {id_type}, samples array<float>").withColumnRenamed("id", id_col)
