"""Runs of repeated words by string synchronising sets.

A run of a text is a stretch of consecutive words with smallest period q (words q apart are identical) that no
neighbouring word extends keeping period q, of at least ``max(MIN_LENGTH, 3 * q)`` words.  All runs are found, by comparing words:

* Periods below ``3 * FIRST_SCALE`` are looked for directly, by comparing the words with themselves q further.
* For each scale t = ``FIRST_SCALE``, twice that, and so on, a place is in the synchronising set if the least hash of the
  stretches of t words that start at it and up to t words later, without those of a period of t / 3 or less,
  is that of the first or of the last of them.  Membership depends on the 2 t words from the place on alone, so stretches that read
  the same have the same places.  Among any t neighbouring places there is one of the set, unless the 3 t - 1 words there have
  a period of t / 3 or less.  So a run of smallest period q in [3 t, 6 t) has two places q apart whose 2 t words are equal:
  pairs of places with equal contexts in that distance propose all such periods.  The places left out, where the
  period is t / 3 or less, are known from the runs of smaller scales, and those runs supply the small periods.
* A proposal is extended both ways by comparing words.  Stretches that are found with several periods keep the least.

Hashes only propose; equal words have equal numbers, so a result never depends on a hash.  A task takes texts in
groups of bounded size, joined with separators that occur once, so that no run crosses a text.

Cases: words are cut at the six ASCII white-space characters; a null or empty text has no words and no runs, and its collapsed
text is empty; rows that repeat are each treated alone; no column is read but the text, and all columns are kept but
those named ``n_words``, ``runs`` and ``collapsed``, which are replaced.  A text of any length is one unit of work.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

MIN_LENGTH = 24
FIRST_SCALE = 4
#: Bytes of text that are searched together, unless one text has more.
GROUP_BYTES = 1 << 20
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _pairs(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of stretches twice as long, from those of stretches of ``step`` words."""
    return _mix(h[:-step] * _U(0xA0761D6478BD642F) + h[step:]) if len(h) > step else h[:0]


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the half-open intervals."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def _short_periods(words: np.ndarray, below: int) -> np.ndarray:
    """(start, end, period) of all maximal stretches of three periods or more, for every period less than ``below``, its multiples too."""
    out = []
    for q in range(1, min(below, len(words) // 3 + 1)):
        same = np.zeros(len(words) - q + 2, bool)
        same[1:-1] = words[q:] == words[:-q]
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= 2 * q
        if long.any():
            out.append(np.stack([starts[long], ends[long] + q, np.full(long.sum(), q)], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def _agree(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from places a < b on agree, forwards (step 1) or backwards (step -1)."""
    n, done, size = len(words), 0, 32
    room = n - b if step == 1 else a + 1
    while done < room:
        size = min(size, room - done)
        if step == 1:
            x, y = words[a + done : a + done + size], words[b + done : b + done + size]
        else:
            x, y = (words[p - done - size + 1 : p - done + 1][::-1] for p in (a, b))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done += size
        size *= 4
    return done


def _proposals(context: np.ndarray, places: np.ndarray, scale: int) -> np.ndarray:
    """(distance, first place) of pairs of places with equal contexts, 3 to 6 times the scale apart.

    A run has so long an agreement that the context before or the one after agrees too.
    """
    own = context[places]
    order = np.lexsort((places, own))
    places, own = places[order], own[order]
    out, lag = [], 1
    left = np.arange(len(places))
    while len(left):
        left = left[left + lag < len(places)]
        left = left[own[left] == own[left + lag]]
        first, second = places[left], places[left + lag]
        near = second - first < 6 * scale
        left, first, second = left[near], first[near], second[near]
        wide = 2 * scale
        after = second + wide < len(context)
        good = np.zeros(len(first), bool)
        good[after] = context[first[after] + wide] == context[second[after] + wide]
        before = first >= wide
        good[before] |= context[first[before] - wide] == context[second[before] - wide]
        good &= second - first >= 3 * scale
        out.append(np.stack([second[good] - first[good], first[good]], 1))
        lag += 1
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def find_runs(words: np.ndarray, longest: np.ndarray | None = None, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, period) of all runs, ordered by start and period.

    ``words``: numbers of words, equal for equal words.  ``longest``: pairs (end, length) of joined texts in order of falling
    length, by which large scales look only at texts that have room for their periods.
    """
    words = np.ascontiguousarray(words, np.int64)
    n = len(words)
    sizes = np.asarray([[n, n]]) if longest is None else longest
    found = _short_periods(words, 3 * FIRST_SCALE)
    h, length, scale = _mix(words.astype(_U) + _U(1)), 1, FIRST_SCALE
    while True:
        fits = sizes[sizes[:, 1] >= 9 * scale]
        if not len(fits):
            break
        n = int(fits[-1, 0])  # the texts that can have a run of this scale come first
        part = words[:n]
        h = h[: n - length + 1]
        while length < scale:
            h, length = _pairs(h, length), 2 * length
        context = _pairs(h, scale)
        periodic = (found[:, 2] <= scale // 3) & (found[:, 1] - found[:, 0] >= scale) & (found[:, 1] <= n)
        out = _covered(len(h), found[periodic, 0], found[periodic, 1] - scale + 1)
        ids = np.where(out, _U(0xFFFFFFFFFFFFFFFF), h >> _U(1))  # no hash is as large as what is left out
        least = _window_min(ids, scale + 1)
        least = least[: len(context)]
        chosen = (least == ids[: len(least)]) | (least == ids[scale : scale + len(least)])
        places = np.flatnonzero(chosen & (least != _U(0xFFFFFFFFFFFFFFFF)))
        proposed = np.unique(_proposals(context, places, scale), axis=0)
        new, k = [], 0
        periods, firsts = proposed[:, 0], proposed[:, 1]
        while k < len(proposed):
            q, j = int(periods[k]), int(firsts[k])
            start = j - _agree(part, j - 1, j - 1 + q, -1) if j else 0
            end = j + q + _agree(part, j, j + q, 1)
            if end - start >= 3 * q:
                new.append((start, end, q))
            # what lies in this agreement gives the same stretch again
            same = int(np.searchsorted(periods, q, side="right"))
            k += max(1, int(np.searchsorted(firsts[k:same], end - q)))
        if new:
            found = np.concatenate([found, np.asarray(new, np.int64)])
        scale *= 2
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    least = np.ones(len(found), bool)
    least[1:] = (found[1:, :2] != found[:-1, :2]).any(1)  # the same stretch with a multiple of its period
    found = found[least]
    found = found[found[:, 1] - found[:, 0] >= np.maximum(min_length, 3 * found[:, 2])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def search_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs of each text, given as its words."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    counts = np.asarray([len(texts[k]) for k in order], np.int64)
    if not len(counts):
        return []
    ends = np.cumsum(counts + 1)  # one separator after each text
    starts = ends - counts - 1
    n = int(counts.sum())
    # a word's number is the place where it is met first
    numbers = np.fromiter(map({}.setdefault, itertools.chain.from_iterable(texts[k] for k in order), itertools.count()), np.int64, n)
    joined = np.empty(int(ends[-1]), np.int64)
    separators = np.zeros(len(joined), bool)
    separators[ends - 1] = True
    joined[separators] = n + np.arange(len(counts))
    joined[~separators] = numbers
    found = find_runs(joined, np.stack([ends, counts], 1), min_length)
    at = np.searchsorted(found[:, 0], starts)
    out: list = [None] * len(texts)
    for i, (k, a, b) in enumerate(zip(order, at.tolist(), [*at[1:].tolist(), len(found)])):
        own = found[a:b].copy()
        own[:, :2] -= starts[i]
        out[k] = own
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if every run keeps its first period alone."""
    return ~_covered(n, runs[:, 0] + runs[:, 2], runs[:, 1])


def collapse_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """All columns, and n_words, runs (array of start, length, period, by start and period) and collapsed (kept words and single spaces)."""
    from pyspark.sql.types import StructType

    kept = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    body = "__text"
    while body in docs.columns:
        body += "_"
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias(body))
    extra = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    schema = StructType([*given.schema.fields[:-1], *extra.fields])

    def groups(texts: list[bytes]):
        first = size = 0
        for k, t in enumerate(texts):
            if size and size + len(t) > GROUP_BYTES:
                yield first, k
                first, size = k, 0
            size += len(t)
        yield first, len(texts)

    def search(batches):
        import pyarrow as pa

        run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in slices(batches, 1024):
            raw = as_bytes(batch.column(batch.num_columns - 1))
            for a, b in groups(raw):
                texts = [t.split() for t in raw[a:b]]
                found = search_texts(texts, min_length)
                flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], fields=list(run_type))
                short = []
                for words, own in zip(texts, found):
                    if len(own):
                        words = [words[k] for k in np.flatnonzero(kept_words(len(words), own)).tolist()]
                    short.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(a, b - a).columns[:-1],
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), runs),
                        pa.array(short, pa.binary()),
                    ],
                    names=schema.names,
                )

    return given.mapInArrow(search, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of those that tie; null without runs."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.get(runs, F.lit(0))
    return F.aggregate(runs, none, lambda best, r: F.when(better(r, best), r).otherwise(best))
