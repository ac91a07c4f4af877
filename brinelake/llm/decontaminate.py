"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of 13 consecutive words of benchmark items (an item of fewer words is
one window).  A searcher for windows of one length looks at the block of three words at the end
of the current window: the shift table says how far the window can move without missing an
occurrence, a shift of zero selects the bucket of test windows with that suffix, which is ordered by prefix, and
comparing all words confirms an occurrence.  Words are numbered, a block is one integer, and windows are
places in arrays, so that a set of items takes about 30 times its text in a worker's memory.

Cases: a null or empty text has no words and is never contaminated; a null item_id is ignored;
rows of benchmark that repeat an item_id are one item; repeated rows of documents each give a row;
columns besides the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, slices

WINDOW = 13
BLOCK = 3
#: Bytes of benchmark text that one pass over the documents holds (about 30 times as much in each worker); more items take more passes.
PASS_BYTES = 4 << 20
#: Windows of a part of a long item; buckets that parts are dealt to, for each pass.
PART_WORDS, BUCKETS_OF_SET = 4096, 16
#: A-Z to a-z; other ASCII but digits and a-z to a space; bytes from 0x80 stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_TABLE).split()


class WuManber:
    """Searches lists of word numbers for windows of one length.

    ``numbers`` are the words of all items, one after another, below ``base``; windows start at ``starts``.
    """

    def __init__(self, length: int, numbers: np.ndarray, starts: np.ndarray, items: np.ndarray, base: int):
        # a block is one integer of 63 bits
        self.length, self.block, self.base = length, min(BLOCK if base < 1 << 21 else 2, length), base
        self.far = length - self.block + 1
        size = self.block
        keys = numbers.astype(np.int64)
        blocks = keys[: len(keys) - size + 1].copy()
        for k in range(1, size):  # the block at each place as one integer
            blocks = blocks * base + keys[k : len(keys) - size + 1 + k]
        suffix, prefix = blocks[starts + length - size], blocks[starts]
        order = np.lexsort((starts, prefix, suffix))
        self.numbers = numbers
        self.starts, self.items, self.prefix = starts[order], items[order], prefix[order]
        suffix = suffix[order]
        self.shift: dict[int, int] = {}
        for back in range(length - size, 0, -1):  # places nearer to the end come later and hold
            self.shift.update(dict.fromkeys(np.unique(blocks[starts + length - size - back]).tolist(), back))
        first = np.flatnonzero(np.diff(suffix, prepend=-1))
        self.bounds = np.append(first, len(suffix))
        # a shift of zero stands as the number of its bucket, 0 or less
        self.shift.update(zip(suffix[first].tolist(), range(0, -len(first), -1)))

    def search(self, words: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence, in ascending order of start; words that no item has are -1."""
        length, size, far, shift, n = self.length, self.block, self.far, self.shift, len(words)
        if n < length:
            return
        wide = words.astype(np.int64)
        blocks, known = wide[: n - size + 1].copy(), wide[: n - size + 1] >= 0
        for k in range(1, size):
            part = wide[k : n - size + 1 + k]
            blocks = blocks * self.base + part
            known &= part >= 0
        blocks[~known] = -1
        at = blocks.tolist()
        end, last = length - size, n - size  # where the block at the end of the window begins
        while end <= last:
            step = shift.get(at[end], far)
            if step > 0:
                end += step
                continue
            start = end + size - length
            lo, hi = self.bounds[-step], self.bounds[1 - step]
            prefix = at[start]
            k = lo + int(np.searchsorted(self.prefix[lo:hi], prefix))
            found, here = [], words[start : start + length]
            while k < hi and self.prefix[k] == prefix:
                own = self.starts[k]
                if np.array_equal(self.numbers[own : own + length], here):
                    found.append(int(self.items[k]))
                k += 1
            if found:
                yield start, found
            end += 1


class Searchers:
    """One searcher for each length of window that the items (id, words) have."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        items = [(i, w) for i, w in items if w]
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        numbers = np.fromiter((self.number.setdefault(x, len(self.number)) for _, w in items for x in w), np.int32)
        base = len(self.number)
        sizes = np.asarray([len(w) for _, w in items], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.all: list[WuManber] = []
        for length in sorted({min(window, int(n)) for n in sizes}):
            own = np.flatnonzero(np.minimum(sizes, window) == length)
            count = sizes[own] - length + 1
            of = np.repeat(own, count)
            place = np.repeat(starts[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            self.all.append(WuManber(length, numbers, place, of.astype(np.int32), base))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of all occurrences, and the items that have them."""
        spans, found = [], set()
        if words and self.all:
            numbers = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
            for s in self.all:
                for start, items in s.search(numbers):
                    spans.append((start, start + s.length))
                    found.update(self.ids[i] for i in items)
        return spans, found


_built: dict[str, Searchers] = {}


def _searchers(digest: str, items: list[tuple[str, bytes]]) -> Searchers:
    """The searchers of a broadcast set of items, built once in each worker."""
    if digest not in _built:
        _built.clear()
        _built[digest] = Searchers([(i, words_of(t)) for i, t in items])
    return _built[digest]


def _digest(items: list[tuple[str, bytes]]) -> str:
    """What tells sets of items apart: all ids and texts."""
    h = hashlib.sha256()
    for item, body in items:
        for x in (item.encode(), body):
            h.update(len(x).to_bytes(8, "little") + x)
    return h.hexdigest()


def _parts(items: DataFrame, words: int = PART_WORDS, window: int = WINDOW) -> DataFrame:
    """item, body of parts of long items: each has ``words`` windows, and every window of the item is in one part."""

    def split(batches):
        import pyarrow as pa

        for batch in slices(batches):
            names, bodies = [], []
            for item, body in zip(batch.column("item").to_pylist(), as_bytes(batch.column("body"))):
                own = words_of(body)
                windows = len(own) - window + 1
                if windows <= words:
                    pieces = [body]
                else:
                    pieces = [b" ".join(own[at : min(at + words, windows) + window - 1]) for at in range(0, windows, words)]
                names += [item] * len(pieces)
                bodies += pieces
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["item", "body"])

    return items.mapInArrow(split, "item string, body binary")


def _passes(benchmark: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """The number of sets of ``pass_bytes`` at most, and what gathers one of them.

    Windows are the unit of work, so long items are cut.  Parts are dealt to small buckets by a hash, and buckets are put together by their
    measured sizes; a set is larger only if one bucket is, that is if one window is.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body")
    ).where("item is not null")
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    if size <= pass_bytes:
        return 1, lambda k: sorted((r.item, bytes(r.body)) for r in _parts(items).collect())
    buckets = BUCKETS_OF_SET * math.ceil(size / pass_bytes)
    parts = materialize(_parts(items).distinct().withColumn("bucket", F.pmod(F.xxhash64("item", "body"), F.lit(buckets))), "item-parts")
    sets, held = [[]], 0
    for r in sorted(parts.groupBy("bucket").agg(F.sum(F.length("body") + 1).alias("size")).collect()):
        if held and held + r["size"] > pass_bytes:
            sets.append([])
            held = 0
        sets[-1].append(r["bucket"])
        held += r["size"]

    def gather(k: int) -> list[tuple[str, bytes]]:
        return sorted((r.item, bytes(r.body)) for r in parts.where(F.col("bucket").isin(sets[k])).collect())

    return len(sets), gather


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """For each document row: id, n_words, hit spans (word positions, merged), items found (sorted).

    Items are broadcast in sets whose size is checked.  With one set the documents are read once and never shuffled.
    More sets take one pass each over a copy of the rows, so that a worker and the driver hold one set at a time; only what
    they find is kept, and gathered by row at the end.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    n, gather = _passes(benchmark, item_col, item_text_col, pass_bytes)

    def search(rows: DataFrame, items: list[tuple[str, bytes]], keep: list[str], only_hits: bool) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast((_digest(items), items))
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches):
            import pyarrow as pa

            searchers = _searchers(*shared.value)
            for batch in slices(batches):
                counts, spans, found = [], [], []
                for body in as_bytes(batch.column("body")):
                    words = words_of(body)
                    hits, names = searchers.search(words)
                    counts.append(len(words))
                    spans.append(merge_spans(hits))
                    found.append(sorted(names))
                out = pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                    names=[*keep, "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(x) for x in found])) if only_hits else out

        return rows.mapInArrow(run, f"{kinds}, n_words long, spans array<int>, items array<string>"), shared

    if n == 1:
        out = search(rows, gather(0), ["id", "body"], False)[0]
        return out.select(F.col("id").alias(id_col), F.col("body").alias(text_col), "n_words", "spans", "items")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    found = None
    for k in range(n):
        part, shared = search(rows, gather(k), ["row"], k > 0)
        part = materialize(part, "occurrences")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = F.pandas_udf(lambda c: c.map(lambda x: merge_spans(list(zip(x[::2], x[1::2])))), "array<int>")
    out = rows.join(sums, "row")
    return out.select(F.col("id").alias(id_col), F.col("body").alias(text_col), "n_words", merged("spans").alias("spans"), "items")


def merge_spans(spans: list[tuple[int, int]]) -> list[int]:
    """Flat list start, end, start, end ... of the union of half-open spans."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document row."""
    found = find_contamination(docs, benchmark, **options)
    n_hit = F.expr(
        "aggregate(transform(spans, (x, i) -> cast(if(i % 2 = 0, -x, x) as bigint)), 0L, (a, x) -> a + x)"
    )
    return found.select(
        options.get("id_col", "doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
