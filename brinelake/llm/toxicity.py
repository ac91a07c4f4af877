"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting takes a bounded sample of labelled rows (``PER_CLASS`` of each label, drawn by a hash of the id).
Terms are all words and beginnings of words in that sample; none is left out.  A term weighs its idf, counted
over all documents, times its phi coefficient with the labels in the sample, so a rare term that the labels
single out counts, and the many that they don't weigh little.  As a term's own beginnings are terms too, a word is known by
the longest term that it is or begins with; a text is stored as those and counted up to all of its terms when
they are needed.  The examples' normalised vectors are
stored as postings by term, those of the ``DENSE`` most frequent terms in blocks of ``BLOCK`` examples with the
greatest weight of each term in each block.  A search adds the short postings up, takes blocks by their upper
bound, and ends when no bound reaches the k-th best cosine found, so the neighbours are exact.  Votes weigh more the nearer the example; an isotonic table fitted on
leave-one-out votes turns them into calibrated scores.  The neighbours are returned as evidence.

Cases: null and empty texts, and texts with no term, have no neighbours and get the share of label 1
among examples like them; null labels and labels without a document are ignored; of labels that
repeat a doc_id the greatest counts; without any labelled rows every score is 0.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, as_text, held_out, materialize, release_memory, slices

#: Examples of each label; most terms whose postings are stored in blocks; terms whose frequencies are counted in one row.
PER_CLASS, DENSE, CHUNK = 2000, 2048, 8192
#: Words whose terms a worker remembers.
REMEMBER = 200_000
#: Neighbours; examples of a block; lengths of word beginnings, in characters; share of a vote that the base rate has.
NEIGHBOURS, BLOCK, PREFIXES, BASE = 15, 64, range(3, 9), 0.5
#: Blocks that a search scans before it compares bounds with the k-th best cosine.
FIRST_BLOCKS = 2
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings (marked by a star), the longest first."""
    return [word, *(word[:n] + "*" for n in reversed(PREFIXES) if n < len(word))]


class Tree:
    """The next shorter term of each term (-1 for none), by their numbers."""

    def __init__(self, parent: np.ndarray):
        self.parent, self.size = parent, len(parent)

    def all_terms(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """From (longest terms, counts) of each text: all its terms in ascending order and their counts."""
        sizes = [len(t) for t, _ in texts]
        if not sum(sizes):
            return [(np.empty(0, np.int32), np.empty(0, np.int32))] * len(texts)
        text = np.repeat(np.arange(len(texts)), sizes)
        term, count = (np.concatenate([x[i] for x in texts]).astype(np.int64) for i in (0, 1))
        keys, counts = [], []
        while len(term):
            keys.append(text * self.size + term)
            counts.append(count)
            term = self.parent[term]
            on = term >= 0
            text, term, count = text[on], term[on].astype(np.int64), count[on]
        key, count = np.concatenate(keys), np.concatenate(counts)
        if len(key) < 1 << 24 and len(texts) * self.size < 1 << 39:  # sorting values is faster than sorting places by them
            key = np.sort(key << 24 | np.arange(len(key)))
            key, count = key >> 24, count[key & 0xFFFFFF]
        else:
            order = np.argsort(key)
            key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[first], np.add.reduceat(count, first)
        ends = np.searchsorted(key, np.arange(1, len(texts)) * self.size)
        return list(zip(np.split((key % self.size).astype(np.int32), ends), np.split(count.astype(np.int32), ends)))


class Lexicon:
    """Numbers of terms, which are their places in the list given, and the next shorter term of each (-1 for none)."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self._tables()
        self.tree = Tree(np.fromiter(map(self._shorter, terms), np.int32, len(terms)))

    def _shorter(self, term: str) -> int:
        """The longest beginning of the term that is a term itself."""
        whole = term.removesuffix("*")
        return self._beginning(whole, len(whole) - 1)

    def _beginning(self, word: str, most: int) -> int:
        for n in range(min(PREFIXES[-1], most), PREFIXES[0] - 1, -1):
            found = self.beginnings.get(word[:n])
            if found is not None:
                return found
        return -1

    def _tables(self) -> None:
        self.words = {t: i for i, t in enumerate(self.terms) if t[-1] != "*"}
        self.beginnings = {t[:-1]: i for i, t in enumerate(self.terms) if t[-1] == "*"}

    def drop_tables(self) -> None:
        """The driver needs terms and tree alone, once it has them; workers make their own tables."""
        self.words, self.beginnings = {}, {}

    def __getstate__(self) -> str:
        return "\n".join(self.terms)

    def __setstate__(self, state: str) -> None:  # only the tables, which texts need
        self.terms = state.split("\n") if state else []
        self._tables()
        del self.terms

    def longest(self, word: str) -> int:
        """The number of the longest term that the word is or begins with, or -1."""
        found = self.words.get(word)
        return found if found is not None else self._beginning(word, len(word) - 1)


class _Words:
    """Longest terms of words, remembered."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def counts(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each text its longest terms in ascending order, and how often each occurs."""
        found = [_WORD.findall(t.lower()) for t in texts]
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        new = set().union(*found).difference(known)
        known.update(zip(new, map(self.lexicon.longest, new)))
        out = []
        for words in found:
            sums = Counter(map(known.__getitem__, words))
            sums.pop(-1, None)
            terms = sorted(sums)
            out.append((terms, [sums[t] for t in terms]))
        for w in new:
            if len(w) > 48:
                del known[w]
        return out


class Index:
    """Postings of the examples in blocks, with the greatest weight of each term in each block."""

    def __init__(self, idf: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, labels: np.ndarray, weights: np.ndarray):
        self.idf = idf
        unit = [self.unit(t, c) for t, c in vectors]
        # examples with the same strongest term are next to each other, which keeps the bounds tight
        order = sorted(range(len(unit)), key=lambda i: (int(unit[i][0][unit[i][1].argmax()]) if len(unit[i][0]) else -1, i))
        self.ids, self.labels, self.weights = [ids[i] for i in order], labels[order], weights[order]
        self.unit_vectors = [unit[i] for i in order]
        self.blocks = max(1, math.ceil(len(order) / BLOCK))
        terms = np.concatenate([np.empty(0, np.int32), *(t for t, _ in self.unit_vectors)])
        by_term = np.argsort(terms, kind="stable")
        self.starts = np.searchsorted(terms[by_term], np.arange(len(idf) + 1))
        self.at = np.repeat(np.arange(len(order), dtype=np.int32), [len(t) for t, _ in self.unit_vectors])[by_term]
        self.values = np.concatenate([np.empty(0, np.float32), *(v for _, v in self.unit_vectors)])[by_term]
        self._spread()

    def _spread(self) -> None:
        """Postings of the most frequent terms in a block, as the weights of the block's examples, and their bounds."""
        often = np.argsort(-np.diff(self.starts), kind="stable")[:DENSE]
        self.row = np.full(len(self.idf), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.postings = np.zeros((self.blocks, len(often), BLOCK), np.float32)
        for row, t in enumerate(often):
            own = slice(self.starts[t], self.starts[t + 1])
            self.postings[self.at[own] // BLOCK, row, self.at[own] % BLOCK] = self.values[own]
        self.bound = np.ascontiguousarray(self.postings.max(2).T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("unit_vectors", "row", "postings", "bound")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._spread()

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = ((1 + np.log(counts)) * self.idf[terms]).astype(np.float32)
        norm = math.sqrt(float(np.square(values, dtype=float).sum()))
        return terms, values / norm if norm else values

    def search(self, terms: np.ndarray, values: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a positive cosine, of equal ones the first; ``but`` is left out."""
        return self.search_all([(terms, values)], k, [but])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``search`` for each of the queries (terms, values)."""
        wanted = np.zeros((len(queries), len(self.bound)), np.float32)
        scores = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        for i, (terms, values) in enumerate(queries):
            row = self.row[terms]
            often = row >= 0
            wanted[i, row[often]] = values[often]
            starts, n = self.starts[terms[~often]], self.starts[terms[~often] + 1] - self.starts[terms[~often]]
            places = np.repeat(starts - n.cumsum() + n, n) + np.arange(n.sum())
            scores[i] = np.bincount(self.at[places], self.values[places] * np.repeat(values[~often], n), scores.shape[1])
        bounds = wanted @ self.bound + scores.reshape(len(queries), self.blocks, BLOCK).max(2)
        left_out = [(i, b) for i, b in enumerate(but or ()) if b >= 0]

        def kth(scanned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Cosines of scanned blocks, and the k-th best of each query."""
            known = np.where(np.repeat(scanned, BLOCK, 1), scores, 0)
            for i, b in left_out:
                known[i, b] = 0
            return known, np.partition(known, -min(k, known.shape[1]), 1)[:, -min(k, known.shape[1])]

        first = np.zeros(bounds.shape, bool)
        np.put_along_axis(first, np.argsort(-bounds, 1, kind="stable")[:, :FIRST_BLOCKS], True, 1)
        self._scan(wanted, scores, first)
        # blocks that may hold a better example come next
        rest = ~first & (bounds > 0) & (bounds >= kth(first)[1][:, None] - 1e-5)
        self._scan(wanted, scores, rest)
        out = []
        for cosines, least in zip(*kth(first | rest)):
            places = np.flatnonzero((cosines > 0) & (cosines >= least - 2e-5))
            near = np.round(cosines[places].astype(float), 5)
            best = np.lexsort((places, -near))[:k]
            out.append((places[best], near[best]))
        return out

    def _scan(self, wanted: np.ndarray, scores: np.ndarray, blocks: np.ndarray) -> None:
        """Adds the frequent terms' share to the scores of each query's ``blocks``."""
        for b in np.flatnonzero(blocks.any(0)):
            i = np.flatnonzero(blocks[:, b])
            scores[i, b * BLOCK : (b + 1) * BLOCK] += wanted[i] @ self.postings[b]


class Model:
    """Index, base rates and calibration."""

    def __init__(self, index: Index):
        self.index = index
        y, w = index.labels, index.weights
        bare = np.asarray([not len(t) for t, _ in index.unit_vectors], bool)
        share = lambda m: float((y * w)[m].sum() / w[m].sum()) if w[m].sum() else 0.0
        self.base, self.bare = share(np.ones(len(y), bool)), share(bare) if bare.any() else share(np.ones(len(y), bool))
        own = np.flatnonzero(~bare)
        votes = np.asarray(
            [
                self.vote(*near)
                for at in range(0, len(own), 256)
                for near in index.search_all([index.unit_vectors[i] for i in own[at : at + 256]], but=own[at : at + 256].tolist())
            ]
        )
        self.knots, self.values = isotonic(votes, y[own], w[own])
        index.unit_vectors = []  # only fitting needs them

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        near = self.index.weights[places] / (1.05 - cosines)
        return float((near @ self.index.labels[places] + BASE * self.base) / (near.sum() + BASE))

    def score(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, places and cosines of neighbours of each text, given by its terms and their counts."""
        out = []
        for places, cosines in self.index.search_all([self.index.unit(*v) for v in vectors]):
            at = max(0, bisect.bisect_right(self.knots, self.vote(places, cosines)) - 1) if len(places) else None
            out.append((self.bare if at is None else self.values[at], places, cosines))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Steps of the best increasing fit of y by x: where each begins, and its value."""
    if not len(x):
        return [0.0], [0.0]
    starts, values, masses = [], [], []
    for i in np.argsort(x, kind="stable"):
        if starts and starts[-1] == x[i]:
            total = masses[-1] + w[i]
            values[-1], masses[-1] = (values[-1] * masses[-1] + y[i] * w[i]) / total, total
        else:
            starts.append(float(x[i]))
            values.append(float(y[i]))
            masses.append(float(w[i]))
        while len(values) > 1 and values[-2] >= values[-1]:
            total = masses[-2] + masses[-1]
            values[-2] = (values[-2] * masses[-2] + values[-1] * masses[-1]) / total
            masses[-2] = total
            del values[-1], masses[-1], starts[-1]
    return starts, [float(v) for v in values]


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of training rows, and the number of training rows of each label."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    # ids and hashes meet the labels; texts never move but those that are drawn
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held_out() & F.col("doc_id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    train = materialize(rows.select("doc_id", "h").join(known, "doc_id"), "labelled-rows")
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000))
    # a share by hash first, so that the final order covers few rows
    share = F.lit(0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, int(min(1.0, 1.5 * per_class / n) * 1_000_000)).otherwise(share)
    place = F.row_number().over(Window.partitionBy("y").orderBy(draw, "doc_id", "h"))
    drawn = train.where(draw < share).distinct().withColumn("place", place).where(F.col("place") <= per_class).drop("place")
    # at most per_class rows of each label
    found = rows.join(F.broadcast(drawn), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))
    return found.drop("h"), sizes


def sample_terms(sample: DataFrame, drawn: dict[int, int]) -> tuple[Lexicon, np.ndarray]:
    """All terms of the sample, and how far the labels single each out (its phi coefficient, 0 to 1)."""

    def term_counts(batches):
        import pyarrow as pa

        for batch in slices(batches):
            counts: dict[str, list[int]] = {}
            for text, y in zip(as_text(batch.column("text")), batch.column("y").to_pylist()):
                for t in {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}:
                    counts.setdefault(t, [0, 0])[y] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
                names=["term", "n0", "n1"],
            )

    n0, n1 = drawn.get(0, 0), drawn.get(1, 0)
    n = n0 + n1
    stats = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(term_counts, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("a"), F.sum("n1").alias("b"))
    found = stats.withColumn("df", F.col("a") + F.col("b")).toArrow().sort_by([("df", "descending"), ("term", "ascending")])
    a, b = (found.column(c).to_numpy().astype(float) for c in "ab")
    df = a + b
    phi = np.abs(b * n0 - a * n1) / np.sqrt(np.maximum(float(n0) * n1 * df * (n - df), 1.0))
    return Lexicon(found.column("term").to_pylist()), phi


def term_vectors(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, columns of ``keep``, and the longest terms of each text with their counts, in the order of terms."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import pyarrow as pa

        words = _Words(shared.value)
        for batch in slices(batches):
            counts = words.counts(as_text(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "held_out", *keep)),
                    pa.array([t for t, _ in counts], pa.list_(pa.int32())),
                    pa.array([n for _, n in counts], pa.list_(pa.int32())),
                ],
                names=["doc_id", "held_out", *keep, "terms", "counts"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), *keep, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, {kept}terms array<int>, counts array<int>")


def document_frequencies(vectors: DataFrame, tree: Tree) -> tuple[np.ndarray, int]:
    """Documents that have each of the terms, and the number of all; a task sends one row for each ``CHUNK`` of terms."""
    terms, shared = tree.size, vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        import pyarrow as pa

        found, total = np.zeros(terms, np.int64), 0
        for batch in slices(batches):
            total += batch.num_rows
            for own, _ in shared.value.all_terms(list(zip(arrays(batch.column("terms")), arrays(batch.column("counts"))))):
                found[own] += 1
        parts = [found[at : at + CHUNK] for at in range(0, terms, CHUNK)] + [np.asarray([total])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["part", "n"])

    def added(pdf):
        import pandas as pd

        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "n": [np.sum(list(pdf["n"]), axis=0)]})

    rows = vectors.select("terms", "counts").mapInArrow(run, "part int, n array<long>").groupBy("part").applyInPandas(added, "part int, n array<long>")
    counts = np.concatenate([np.empty(0, int), *(r["n"] for r in sorted(rows.collect()))])
    return (counts[:-1], int(counts[-1])) if len(counts) else (np.zeros(terms, int), 0)


def arrays(column) -> list[np.ndarray]:
    """A column of lists of integers, each as one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, keep: tuple[str, ...] = ()) -> tuple[Model | None, DataFrame, Tree]:
    """A model from labelled rows that aren't held out, the term vectors of all rows (with columns of ``keep``), which are written once, and the tree of their terms.

    Document frequencies are counted over all rows.
    """
    release_memory()  # of earlier stages
    sample, sizes = _sample(docs, labels, per_class)
    sample = materialize(sample, "toxicity-sample")
    drawn = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    lexicon, phi = sample_terms(sample, drawn) if drawn else (Lexicon([]), np.empty(0))
    lexicon.drop_tables()
    release_memory()
    vectors = materialize(term_vectors(docs, lexicon, keep), "term-vectors")
    if not drawn:
        return None, vectors, lexicon.tree
    seen, total = document_frequencies(vectors, lexicon.tree)
    idf = 1 + np.log((1 + total) / (1 + seen))
    examples = term_vectors(sample.withColumn("y", F.col("y").cast("int")), lexicon, ("y",)).toArrow()
    ids = examples.column("doc_id").to_pylist()
    tree = lexicon.tree
    longest = list(zip(*(arrays(examples.column(c).combine_chunks()) for c in ("terms", "counts"))))
    # few texts at a time, as their keys take several times the room of the result
    terms, counts = zip(*[v for at in range(0, len(longest), SLICE_ROWS) for v in tree.all_terms(longest[at : at + SLICE_ROWS])])
    del longest
    y = examples.column("y").to_numpy().astype(float)
    del lexicon, examples
    release_memory()  # before the index takes some
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    y = y[order]
    weights = np.asarray([sizes[int(v)] / drawn[int(v)] for v in y])
    return Model(Index(idf * phi, [(terms[i], counts[i]) for i in order], [ids[i] for i in order], y, weights)), vectors, tree


def score(vectors: DataFrame, model: Model | None, tree: Tree, evidence: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids, labels and cosines of the nearest examples) for each row of term vectors."""
    id_type = vectors.schema["doc_id"].dataType.simpleString()
    kind = f"array<struct<doc_id: {id_type}, label: int, cosine: double>>"
    if model is None:
        return vectors.select("doc_id", "held_out", *keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.array().cast(kind).alias("evidence"))
    shared = vectors.sparkSession.sparkContext.broadcast((model, tree))

    def run(batches):
        import pyarrow as pa

        m, tree = shared.value
        known: dict = {}
        for batch in slices(batches):
            ids = batch.column("doc_id")
            texts = list(zip(arrays(batch.column("terms")), arrays(batch.column("counts"))))
            keys = [t.tobytes() + c.tobytes() for t, c in texts]
            if len(known) > 5_000:
                known.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in known}
            for key, (s, places, cosines) in zip(new, m.score(tree.all_terms(list(new.values())))):
                near = zip(places[:evidence].tolist(), cosines.tolist())
                known[key] = s, [{"doc_id": m.index.ids[p], "label": int(m.index.labels[p]), "cosine": float(c)} for p, c in near]
            scores, seen = [known[k][0] for k in keys], [known[k][1] for k in keys]
            row = pa.struct([("doc_id", ids.type), ("label", pa.int32()), ("cosine", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [ids, *(batch.column(c) for c in ("held_out", *keep)), pa.array(scores, pa.float64()), pa.array(seen, pa.list_(row))],
                names=["doc_id", "held_out", *keep, "score", "evidence"],
            )

    kept = "".join(f"{c} {vectors.schema[c].dataType.simpleString()}, " for c in keep)
    out = vectors.mapInArrow(run, f"doc_id {id_type}, held_out boolean, {kept}score double, evidence {kind}")
    return out.select("doc_id", "held_out", *keep, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Fit on the labelled rows and score every row; columns of ``keep`` are kept."""
    model, vectors, tree = fit(docs, labels, keep=keep, **options)
    return score(vectors, model, tree, keep=keep)
