"""Token counts by the tokenizers or sentencepiece library, in Arrow functions that return lengths only.

Texts are gathered into batches of about ``BATCH_BYTES``.  Each text is split at safe boundaries,
where no token of the vocabulary can reach across, so that a very long text is only ever encoded in
short pieces; the pieces of a batch that were not counted before go to the library in one call.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, slices

BATCH_BYTES = 1 << 20
#: Pieces whose counts a worker remembers, and the longest piece that it remembers.
REMEMBER, REMEMBER_CHARS = 600_000, 48
_ODD = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(r"[ \t\n\r]+")


class WordCounter:
    """Counts for a tokenizer that drops white space: any white space is a safe boundary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        # str.split() also splits at four control characters that the tokenizer doesn't take as white space
        return _SPLIT.split(text) if _ODD.search(text) else text.split()

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        known, split = self.known, [self.pieces(t) for t in texts]
        if len(known) > REMEMBER:
            known.clear()
        new = list({p for pieces in split for p in pieces if p not in known})
        known.update(zip(new, self.encode(new)))
        out = [sum(map(known.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > REMEMBER_CHARS:
                del known[p]
        return out


class PieceCounter(WordCounter):
    """Counts for sentencepiece, which marks a space inside the text: whole texts are encoded."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _counters:
        _counters[path] = (PieceCounter if path.endswith(".model") else WordCounter)(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row.

    ``tokenizer``: path of a sentencepiece .model, or of a tokenizers .json whose pre-tokenizer drops
    white space.  Narrow: rows stay in their partitions and only the id and three numbers return.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = counter(tokenizer)
        for batch in slices(batches, 1024):
            texts = as_text(batch.column("text"))
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            counts: list[int] = []
            group: list[str] = []
            held = 0
            for text, size in zip(texts, sizes):
                if group and held + size > BATCH_BYTES:
                    counts += c.counts(group)
                    group, held = [], 0
                group.append(text)
                held += size
            counts += c.counts(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
