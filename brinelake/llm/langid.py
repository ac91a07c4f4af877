"""Language identification by a bidirectional gated recurrent network over bytes.

A sequence is one word of the text with the spaces around it, in pieces of ``MAX_BYTES`` at most that are cut between
characters; the recurrence doesn't cross from word to word, so that a word is labelled once.  The network
reads its bytes in both directions and labels every position; a document's probabilities are the pooled
(geometric mean) probabilities of all positions of all its words.  Training is backpropagation through
time with Adam, in numpy on the driver, over a bounded sample: ``DOCS_PER_LANG`` documents of each language,
``WORDS_PER_DOC`` words spread evenly over each.  Scoring reads every word of every text; a worker
remembers the labels of words it has met, since they depend on the word alone.

Cases: a null text, or one without any letter, is ``und`` with score 0; documents without lang, and held-out
ones, aren't learned from; if nothing can be learned everything is ``und``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, as_text, held_out, slices

DOCS_PER_LANG, WORDS_PER_DOC, MAX_BYTES = 300, 150, 24
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 200, 256, 0.03, 7
REMEMBER = 600_000
PAD = 32


def sequences(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    """Sequences of words, and the word each belongs to."""
    out, of = [], []
    for k, w in enumerate(words):
        w, at = b" " + w + b" ", 0
        while at < len(w):
            end = at + MAX_BYTES
            while at + 4 < end < len(w) and w[end] & 0xC0 == 0x80:  # not inside a character
                end -= 1
            out.append(w[at:end])
            of.append(k)
            at = end
    return out, of


def to_array(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, mask) of equal width."""
    width = max(map(len, rows))
    x = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    return x, np.arange(width)[None, :] < np.fromiter(map(len, rows), int)[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward pass and backpropagation through time."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n, k = hidden, len(langs)
        self.langs, self.hidden = langs, hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * n)).astype(np.float32)  # input weights: a row for each byte
            self.p["u" + d] = rng.normal(0, 1 / np.sqrt(n), (n, 3 * n)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * n, np.float32)
        self.p["w"] = rng.normal(0, 0.3, (2 * n, k)).astype(np.float32)
        self.p["v"] = np.zeros(k, np.float32)

    def _run(self, d: str, x: np.ndarray, m: np.ndarray, keep: bool):
        n, p = self.hidden, self.p
        size, width = x.shape
        h = np.zeros((size, n), np.float32)
        out = np.zeros((width, size, n), np.float32)
        tape = []
        u, c = p["u" + d], p["c" + d]
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            gx = p["x" + d][x[:, t]] + c
            gh = h @ u
            zr = _sigmoid(gx[:, : 2 * n] + gh[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            cand = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
            on = m[:, t, None]
            new = np.where(on, (1 - z) * cand + z * h, h)
            if keep:
                tape.append((t, h, z, r, cand, gh[:, 2 * n :], on))
            h = out[t] = new
        return out, tape

    def labels(self, x: np.ndarray, m: np.ndarray, keep: bool = False):
        """Log-probabilities (width, rows, languages) of every position."""
        hf, tf = self._run("f", x, m, keep)
        hb, tb = self._run("b", x, m, keep)
        h = np.concatenate([hf, hb], axis=2)
        logits = h @ self.p["w"] + self.p["v"]
        logits -= logits.max(2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        return logp, h, tf, tb

    def gradients(self, x: np.ndarray, m: np.ndarray, y: np.ndarray):
        logp, h, tf, tb = self.labels(x, m, True)
        n, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        mask = m.T[:, :, None]
        rows = np.arange(len(y))
        loss = -float((logp[:, rows, y] * m.T).sum() / m.sum())
        d = np.exp(logp)
        d[:, rows, y] -= 1
        d = d * mask / m.sum()
        g["w"], g["v"] = np.einsum("tbh,tbk->hk", h, d), d.sum((0, 1))
        dh_all = d @ self.p["w"].T
        for side, tape, part in (("f", tf, dh_all[:, :, :n]), ("b", tb, dh_all[:, :, n:])):
            u, carry = self.p["u" + side], np.zeros((len(y), n), np.float32)
            inputs = []
            for t, before, z, r, cand, ghn, on in reversed(tape):
                dh = carry + part[t]
                live = dh * on
                dcand = live * (1 - z) * (1 - cand * cand)
                dz = live * (before - cand) * z * (1 - z)
                dr = dcand * ghn * r * (1 - r)
                dx = np.concatenate([dz, dr, dcand], axis=1)
                dgh = np.concatenate([dz, dr, dcand * r], axis=1)
                carry = dh * ~on + live * z + dgh @ u.T
                g["u" + side] += before.T @ dgh
                g["c" + side] += dx.sum(0)
                inputs.append((x[:, t], dx))
            # rows of the same byte are summed in one pass over all positions
            byte, dx = (np.concatenate(c) for c in zip(*inputs))
            order = np.argsort(byte, kind="stable")
            first = np.flatnonzero(np.diff(byte[order].astype(int), prepend=-1))
            g["x" + side][byte[order][first]] = np.add.reduceat(dx[order], first)
        return loss, g

    def train(self, words: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> float:
        rng = np.random.default_rng(seed)
        seqs, of = sequences(words)
        y = y[np.asarray(of)]
        # each language has the same share of every batch
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        by = [b for b in by if len(b)]
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        loss = 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])
            x, m = to_array([seqs[i] for i in pick])
            loss, g = self.gradients(x, m, y[pick])
            rate = RATE * (1 - step / (steps + 1))
            for k, v in g.items():
                np.clip(v, -1, 1, out=v)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                self.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def word_labels(self, words: list[bytes], batch: int = 4096) -> np.ndarray:
        """For each word: sums of log-probabilities over its positions, and the number of positions."""
        out = np.zeros((len(words), len(self.langs) + 1), np.float64)
        seqs, of = sequences(words)
        order = np.argsort(np.fromiter(map(len, seqs), int), kind="stable") if seqs else []
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, m = to_array([seqs[i] for i in pick])
            logp = self.labels(x, m)[0]
            owner = np.asarray(of)[pick]
            np.add.at(out, (owner, slice(0, -1)), (logp * m.T[:, :, None]).sum(0))
            np.add.at(out[:, -1], owner, m.sum(1))
        return out


class Labeller:
    """Pools a text's positions, remembering words."""

    def __init__(self, network: Network):
        self.network, self.known, self.table, self.n = network, {}, np.zeros((1 << 12, len(network.langs) + 1)), 0

    def _learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBER:
            self.known.clear()
            self.n = 0
        while self.n + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n : self.n + len(words)] = self.network.word_labels(words)
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def pooled(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Probabilities of the languages for each text, None for a text of white space."""
        split = [t.split() for t in texts]
        new = list({w for words in split for w in words} - self.known.keys())
        if new:
            if len(self.known) + len(new) > REMEMBER:
                new = list({w for words in split for w in words})
            self._learn(new)
        out = []
        for words in split:
            if not words:
                out.append(None)
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), int, len(words))].sum(0)
            mean = total[:-1] / total[-1]
            p = np.exp(mean - mean.max())
            out.append(p / p.sum())
        return out


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, words_per_doc: int = WORDS_PER_DOC, steps: int = STEPS) -> Network | None:
    """Train on a bounded sample of the rows that have lang and aren't held out."""
    train = docs.where("lang is not null and text is not null").where(~held_out())
    sizes = {r["lang"]: r["count"] for r in train.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000))

    def words_of(batches):
        import pyarrow as pa

        for batch in slices(batches):
            rows = []
            for text in as_bytes(batch.column("text")):
                words = text.split()
                step = max(1, len(words) / words_per_doc)
                rows.append([words[int(i * step)] for i in range(min(len(words), words_per_doc))])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), pa.array(rows, pa.list_(pa.binary()))], names=["lang", "place", "words"])

    langs = sorted(sizes)
    share = F.lit(0)  # by hash first, so that the final order covers few rows
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, int(min(1.0, 1.5 * docs_per_lang / n) * 1_000_000)).otherwise(share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text")))
    drawn = train.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(draw < share)
    drawn = drawn.withColumn("place", place).where(F.col("place") <= docs_per_lang)
    words: list[bytes] = []
    y: list[int] = []
    for row in sorted(drawn.select("lang", "place", "text").mapInArrow(words_of, "lang string, place int, words array<binary>").collect()):
        words += [bytes(w) for w in row["words"]]
        y += [langs.index(row["lang"])] * len(row["words"])
    if not words:
        return None
    network = Network(langs)
    network.train(words, np.asarray(y), steps)
    return network


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score for each row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if network is None:
        return texts.select(F.col("id").alias(id_col), "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        import pyarrow as pa

        labeller = Labeller(shared.value)
        for batch in slices(batches):
            texts = as_text(batch.column("text"))
            pooled = labeller.pooled([t.encode() for t in texts])
            langs, scores = [], []
            for text, p in zip(texts, pooled):
                if p is None or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    k = int(p.argmax())
                    langs.append(shared.value.langs[k])
                    scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return texts.mapInArrow(run, f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, **options) -> DataFrame:
    """Fit and identify."""
    return identify(docs, fit(docs, **options))
