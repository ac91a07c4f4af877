"""Target-distribution importance resampling by hashed n-grams.

Features of a text are its runs of 1 to ``ORDERS`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of
its UTF-8 bytes modulo ``BUCKETS``.  A bucket that is commoner in the target texts than in all texts has a gain above zero; a
text's weight is the sum of its features' gains.  Gumbel noise from a hash of the id is added to the weights, and the
highest scores are a draw without replacement in proportion to the exponentials of the weights.

CRCs of all features come from one scan of the words, each followed by one separator: the CRC register is stored after
every byte.  The CRC of the stretch from a to b is ``crc[b] ^ shift(crc[a], b - a)``, where shifting by so many
bytes is linear over GF(2), so what stood before a cancels, and one text after another can be in the same scan.
Shifts of up to 255 bytes have a table of each length; longer ones are composed of powers of two.  The scan itself runs
over many pieces of ``PIECE`` bytes at once, whose registers are joined by shifts too.

Texts are scanned twice, once to count the buckets and once for the weights, as a text's buckets take more room than the text.
A task sends at most one row for each bucket; the gains (one number for each bucket) are all that the driver takes.

Cases: a null or empty text has no words, weight 0 and its noise as score; a null id is hashed as '' and comes after other
ids of the same score; rows that repeat are counted and drawn each; an empty target, or no texts at all, is fine;
no column is read but id and text.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.export import numbered
from .common import as_bytes, materialize, slices

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that are scanned together, unless one text has more; bytes of the pieces that a scan steps through side by side.
GROUP_BYTES, PIECE = 1 << 20, 256
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
#: ASCII digits and letters are kept, capitals lowered; other ASCII separates words, and bytes above it are parts of letters.
_WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@functools.cache
def _step() -> np.ndarray:
    """The register after a zero byte, by the low byte of the register before."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def _linear(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as what each of the four bytes contributes."""
    return table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]


@functools.cache
def _short_shifts() -> np.ndarray:
    """Shifts by 0 to 255 bytes as one flat array, by length, byte of the register and its value."""
    out = np.empty((256, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, 256):
        out[n] = _step()[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out.reshape(-1)


@functools.cache
def _shift_power(k: int) -> np.ndarray:
    """The shift by 2^k bytes."""
    if k < 8:
        return _short_shifts().reshape(256, 4, 256)[1 << k]
    half = _shift_power(k - 1)
    return _linear(half, half)


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after ``lengths`` zero bytes more."""
    table, at = _short_shifts(), (lengths & 255) << 10
    out = table[at + (crc & 255)] ^ table[at + 256 + ((crc >> 8) & 255)]
    out ^= table[at + 512 + ((crc >> 16) & 255)] ^ table[at + 768 + (crc >> 24)]
    rest = lengths >> 8
    k = 8
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _linear(_shift_power(k), out[odd])
        rest = rest >> 1
        k += 1
    return out


class RunningCrc:
    """The CRC register, begun with zero, after every byte."""

    def __init__(self, data: np.ndarray):
        pieces = len(data) // PIECE + 1
        padded = np.zeros(pieces * PIECE, np.uint8)
        padded[: len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(pieces, PIECE).T)
        self.inside = np.zeros((PIECE, pieces), np.uint32)  # the register after so many bytes of a piece
        register, step = np.zeros(pieces, np.uint32), _step()
        for k in range(PIECE):
            self.inside[k] = register
            register = step[(register ^ columns[k]) & 255] ^ (register >> 8)
        # the register after all pieces up to each: neighbours are joined, then pairs, and so on
        reach, k = 1, PIECE.bit_length() - 1
        while reach < pieces:
            register[reach:] ^= _linear(_shift_power(k), register[:-reach])
            reach, k = 2 * reach, k + 1
        self.before = np.concatenate([np.zeros(1, np.uint32), register[:-1]])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The register after the first ``places`` bytes."""
        piece, inside = places // PIECE, places % PIECE
        return self.inside[inside, piece] ^ shift(self.before[piece], inside)


def features(texts: list[bytes], orders: int = ORDERS):
    """The number of words of each text, and for each order the text and the CRC-32 of every feature."""
    whole = np.frombuffer(b" ".join(texts).translate(_WORD_BYTES) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    letter = whole != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each word
    stream = whole[keep]
    ends = np.flatnonzero(stream == 32)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(ends)]
    first_byte = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[np.cumsum(sizes) - sizes]
    text_of = np.searchsorted(first_byte, starts, side="right") - 1
    crcs = RunningCrc(stream)
    at_start, at_end = crcs.at(starts) ^ _ONES, crcs.at(ends) ^ _ONES
    found = []
    for m in range(orders):
        first, last = slice(0, max(len(starts) - m, 0)), slice(m, None)
        inside = text_of[first] == text_of[last]
        crc = at_end[last] ^ shift(at_start[first], ends[last] - starts[first])
        found.append((text_of[first][inside], crc[inside]))
    return np.bincount(text_of, minlength=len(texts)), found


def _groups(texts: list[bytes]):
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield first, k
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, orders: int = ORDERS) -> DataFrame:
    """bucket, n of all features of all texts, for buckets that occur."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, 1024):
            raw = as_bytes(batch.column(0))
            for a, b in _groups(raw):
                for _, crc in features(raw[a:b], orders)[1]:
                    total += np.bincount(crc % buckets, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln) of how much likelier the bucket is in the target, with one more feature in each."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer")
    rows = source.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(both, "bucket", "left")
    rows = rows.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    total = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  one row for each bucket
    ratio = (F.col("t") + 1) * (total("s") + buckets) / ((F.col("s") + 1) * (total("t") + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """id, n_words, n_features, weight of every text; ``gain`` has a number for each bucket."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def weigh(batches):
        import pyarrow as pa

        for batch in slices(batches, 1024):
            raw = as_bytes(batch.column(1))
            for a, b in _groups(raw):
                n_words, found = features(raw[a:b], orders)
                n_features, weight = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for text, crc in found:
                    summed = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[crc % len(gain)])])
                    edges = np.searchsorted(text, np.arange(b - a + 1))
                    n_features += np.diff(edges)
                    weight += np.diff(summed[edges])
                out = [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (n_words, n_features, weight))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "n_words", "n_features", "weight"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long")


def noise(id_col: str = "id", seed: int = SEED):
    """Gumbel noise in thousandths, from a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
) -> DataFrame:
    """id, n_words, n_features, weight, score, rank (null if undrawn) of every text.

    Of the texts of ``least_words`` words or more, ``percent`` of a hundred are drawn, rounded down.
    """
    table = gains(bucket_counts(docs, text_col, buckets, orders), bucket_counts(target, target_col, buckets, orders), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in table.collect():  # as many rows as buckets, whatever the input
        gain[r.bucket] = r.gain
    rows = weights(docs, gain, id_col, text_col, orders).withColumn("score", F.col("weight") + noise("id", seed))
    rows = materialize(rows, "weights")
    fits = F.col("n_words") >= least_words
    drawn = rows.where(fits).count() * percent // 100
    order = rows.where(fits).select("*", (-F.col("score")).alias("__low"), F.col("id").isNull().alias("__last"), F.monotonically_increasing_id().alias("__row"))
    # ranks without one task for all: a range partition and what stands before each part
    ranked = numbered(order, ["__low", "__last", "id", "__row"], "__n")
    rank = F.when(F.col("__n") < drawn, F.col("__n") + 1).cast("long").alias("rank")
    own = ["id", "n_words", "n_features", "weight", "score"]
    out = ranked.select(*own, rank).unionByName(rows.where(~fits).select(*own, F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", id_col)
