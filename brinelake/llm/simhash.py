"""SimHash near-duplicates by exact comparison inside buckets of equal bits.

Bits are cut into more blocks than the radius, so fingerprints in reach of each other agree in all
but ``radius`` blocks at least: each fingerprint stands in one bucket for each choice of blocks that
may agree, and all pairs of a bucket are compared, so no link is lost.  Five blocks do for tens of millions of
fingerprints; where buckets would be too large, there are more blocks, and finer buckets.

If no number of blocks makes buckets small (fingerprints that share most of their bits), every pair of
different fingerprints is compared in tiles unless population counts rule it out: two
fingerprints at distance d differ by at most d in the sum over their bytes of |popcount difference|.
Fingerprints are dealt to groups by the population counts of their first two 16-bit parts.  A task
compares two groups: it sorts them by the population counts of all eight bytes, cuts them into
tiles, skips tile pairs whose ranges of counts are further apart than the radius, and finds the links
of the others with numpy's exclusive-or and bit counts.  It returns a spanning forest of its links, so
a group of k near copies gives k - 1 edges at most from each task, and no link between different
components is lost.

Cases: null and empty texts and texts without words have fingerprint zero, linked like any other; a text
of fewer words than a shingle has is one shingle; exact copies share a fingerprint and are compared
once; a null doc_id takes part and is never the smallest of its component unless all are null.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, slices
from .graph import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows of a tile; least number of groups; most distinct fingerprints of a group.
TILE, GROUPS, GROUP_ROWS = 1024, 16, 1_000_000
_CHUNK = 1 << 16
#: Most comparisons of a fingerprint that buckets may ask for, at the mean; rows up to which buckets are compared many at a time; rows at a time.
COMPARISONS, SMALL, CHUNK = 20_000, 64, 1 << 16
#: A fingerprint of over one in so many rows is a heavy one; there can't be more of them than that.
HEAVY = 1000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()  # for bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.fromiter((h(whole[s:e], 42) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; fp holds the 64 bits as a signed long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            fps = np.asarray([fingerprint(t, shingle) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64), pa.int64())], names=["id", "fp"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(run, f"id {id_type}, fp long")
        .withColumnRenamed("id", id_col)
    )


# --- links inside one task


def _counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8))


def _tiles(fps: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by population counts; where tiles start; least and greatest counts of each."""
    counts = _counts(fps)
    halves = counts.reshape(-1, 4, 2).sum(2, dtype=np.uint8)
    order = np.lexsort((*counts.T[::-1], *halves.T[::-1]))
    fps, counts = fps[order], counts[order].astype(np.int16)
    at = np.arange(0, len(fps), tile)
    return fps, at, np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


class _Forest:
    """Disjoint sets over array positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                self.parent[x] = root
                return root
            root = up

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.find(x), self.find(y)
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            # of two roots the larger goes below the smaller; those that lost to another pair come again
            self.parent[np.maximum(a, b)] = np.minimum(a, b)


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join what links between ``left`` and ``right``, or inside ``left``, join."""
    lf, la, llow, lhigh = _tiles(left, tile)
    rf, ra, rlow, rhigh = (lf, la, llow, lhigh) if right is None else _tiles(right, tile)
    shift = 0 if right is None else len(lf)
    nodes = lf if right is None else np.concatenate([lf, rf])
    sets = _Forest(len(nodes))
    for i in range(len(la)):
        gap = np.maximum(0, np.maximum(rlow - lhigh[i], llow[i] - rhigh)).sum(1)
        near = np.flatnonzero(gap <= radius)
        for j in near[near >= i] if right is None else near:
            a, b = lf[la[i] : la[i] + tile], rf[ra[j] : ra[j] + tile]
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
            if right is None and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                sets.link(x + la[i], y + ra[j] + shift)
    root = sets.find(np.arange(len(nodes)))
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


# --- groups


def _deal(cells: list[tuple[int, int, int]], per: int) -> tuple[dict[tuple[int, int], tuple[int, int]], list[tuple]]:
    """From (p, q, rows) of cells of population counts: cell -> (first group, number of groups), and the ranges of each group."""
    where, boxes, held = {}, [], 0
    for p, q, n in sorted(cells):
        if n > per:  # a large cell alone, dealt to several groups
            k = math.ceil(n / per)
            where[p, q] = (len(boxes), k)
            boxes += [[p, p, q, q]] * k
            held = per
            continue
        if not boxes or held + n > per:
            boxes.append([p, p, q, q])
            held = 0
        boxes[-1] = [min(boxes[-1][0], p), max(boxes[-1][1], p), min(boxes[-1][2], q), max(boxes[-1][3], q)]
        where[p, q] = (len(boxes) - 1, 1)
        held += n
    return where, boxes


def _near(a, b, radius: int) -> bool:
    gap = lambda lo, hi, lo2, hi2: max(0, lo2 - hi, lo - hi2)
    return gap(a[0], a[1], b[0], b[1]) + gap(a[2], a[3], b[2], b[3]) <= radius


def masks(blocks: int, radius: int) -> list[int]:
    """Signed longs: the bits of each choice of ``blocks - radius`` blocks of 64 bits."""
    ends = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    return [sum(own) - (1 << 64) * (sum(own) >> 63) for own in itertools.combinations(bits, blocks - radius)]


def bucket_links(buckets: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links inside buckets join; rows of a bucket stand together, and ``buckets`` has their numbers, which ascend."""
    starts = np.flatnonzero(np.diff(buckets, prepend=-1))
    sizes = np.diff(starts, append=len(fps))
    large = sizes > SMALL
    edges = [forest(fps[a : a + n], None, radius) for a, n in zip(starts[large].tolist(), sizes[large].tolist())]
    sets = _Forest(len(fps))
    left = np.repeat(np.where(large, 0, starts + sizes), sizes) - np.arange(len(fps))  # rows of the bucket from here on
    at, shift = np.flatnonzero(left > 1), 1
    while len(at):
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius]
        sets.link(near, near + shift)
        shift += 1
        at = at[left[at] > shift]
    root = sets.find(np.arange(len(fps)))
    child = np.flatnonzero(root != np.arange(len(fps)))
    edges.append((fps[child], fps[root[child]]))
    return tuple(np.concatenate(side) for side in zip(*edges))


def _in_buckets(fps: DataFrame, masks: list[int]) -> DataFrame:
    choice = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)]))
    return fps.select("fp", choice.alias("b")).select("b.choice", "b.bits", "fp")


def link_buckets(fps: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Edges (a, b) of all buckets; rows go through tasks sorted by bucket, so that a task holds a chunk of them or one bucket."""
    chunk = CHUNK

    def run(batches):
        import pyarrow as pa

        held = np.empty((3, 0), np.int64)

        def edges(rows):
            number = np.cumsum(np.append(0, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
            a, b = bucket_links(number, np.ascontiguousarray(rows[2]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held = np.concatenate([held, [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("choice", "bits", "fp")]], axis=1)
            if held.shape[1] < chunk:
                continue
            last = (held[0] == held[0, -1]) & (held[1] == held[1, -1])  # of this bucket more rows may come
            if not last.all():
                yield edges(held[:, ~last])
                held = held[:, last]
        if held.shape[1]:
            yield edges(held)

    return _in_buckets(fps, masks).repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(run, "a long, b long")


def link_forest(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) with the components that all pairs of ``fp`` within ``radius`` give. ``fp`` must be distinct."""
    for blocks in range(radius + 1, radius + 5):
        own = masks(blocks, radius)
        count = _in_buckets(fps, own).groupBy("choice", "bits").count()
        rows, pairs, largest = count.agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count") / 2), F.max("count")).first()
        if not rows or largest <= group_rows and pairs <= COMPARISONS * rows / len(own):
            return link_buckets(fps, radius, own)
    return link_tiles(fps, radius, groups, group_rows)


def link_tiles(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """As ``link_forest``, by comparing all pairs of groups in tiles."""
    spark = fps.sparkSession
    cell = fps.select(
        "fp",
        F.expr("cast(bit_count(fp & 65535) as int)").alias("p"),
        F.expr("cast(bit_count(shiftrightunsigned(fp, 16) & 65535) as int)").alias("q"),
    )
    # at most 17 x 17 rows, whatever the number of documents
    cells = [tuple(r) for r in cell.groupBy("p", "q").count().collect()]
    n = sum(c for *_, c in cells)
    per = min(group_rows, max(TILE, math.ceil(n / groups)))
    where, boxes = _deal(cells, per)
    # rows (group, pair, side, own): a pair of a group with itself has own set and one side
    dealt_to: list[tuple[int, int, int, bool]] = []
    pairs = 0
    for i, a in enumerate(boxes):
        for j in range(i, len(boxes)):
            if _near(a, boxes[j], radius):
                dealt_to += [(i, pairs, 0, i == j)] + [(j, pairs, 1, False)] * (j > i)
                pairs += 1
    cell_rows = spark.createDataFrame([(p, q, g, k) for (p, q), (g, k) in where.items()], "p int, q int, g int, k int")
    part_rows = spark.createDataFrame(dealt_to, "g int, pair int, side int, own boolean")
    dealt = (
        cell.join(F.broadcast(cell_rows), ["p", "q"])
        .select("fp", (F.col("g") + F.pmod(F.xxhash64("fp"), F.col("k").cast("long"))).cast("int").alias("g"))
        .join(part_rows, "g")  # Spark knows the size of this list, and broadcasts it only if it is small
        .select("pair", "side", "own", "fp")
    )

    def links(pdf):
        import pandas as pd

        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        side = pdf["side"].to_numpy()
        left, right = fp[side == 0], fp[side == 1]
        a = b = np.empty(0, np.uint64)
        if pdf["own"].iloc[0]:
            a, b = forest(left, None, radius)
        elif len(left) and len(right):
            a, b = forest(left, right, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("pair").applyInPandas(links, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, groups: int = GROUPS
) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id for each row."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    edges = materialize(link_forest(least.select("fp"), radius, groups), "links")
    roots = connected_components(edges)
    named = least.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(smallest, "root").select("fp", "component_id")
    of_fp = materialize(least.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "components")
    # a heavy fingerprint's rows stay where they are: at most HEAVY rows are broadcast
    total = of_fp.agg(F.sum("n")).first()[0] or 0
    heavy = of_fp.where(F.col("n") * HEAVY > total).drop("n")
    rest = prints.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(of_fp.drop("n"), "fp")
    out = prints.join(F.broadcast(heavy), "fp").select(*rest.columns).unionByName(rest)
    return out.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
