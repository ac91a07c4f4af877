"""Token-ID files with Simple-8b word-aligned coding.

A word of 64 bits has a selector in its top four bits and ids of one width in the other 60:

    selector   1    2   3   4   5   6   7   8   9  10  11  12  13  14  15
    ids      240   60  30  20  15  12  10   8   7   6   5   4   3   2   1
    bits       0    1   2   3   4   5   6   7   8  10  12  15  20  30  60

Selector 0 is the escape: its low 60 bits say how many words follow that hold one whole 64-bit id
each, for ids of 2^60 and more.  The coder takes, at each place, the selector that covers most ids.

A file holds blocks, one Parquet row each: the documents of the block in ascending doc_id order,
where each of them starts (``doc_starts``, in ids), the number of ids before every 512th word
(``anchors``) and the words.  Both kinds of offset let a reader decode part of a block.

Cases: a null text is encoded as empty, so it has the end id alone; a null doc_id sorts first;
rows that repeat a doc_id are ordered by a hash of their texts and each has its own place.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, shared_path, slices

COUNTS = (0, 240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Ids at which a block is closed after the current document; words between two anchors.
BLOCK_IDS, ANCHOR = 1 << 16, 512
#: Rows that are encoded at a time, as a piece is looked up once for all of them.
ENCODE_ROWS = 1024
#: Runs of narrow ids that are marked one by one.
FEW_RUNS = 256
END_ID = 0
#: Pieces that a worker remembers, the longest of them, and the characters of new pieces that go to the library as one text.
REMEMBER, REMEMBER_CHARS, CALL_CHARS = 1_000_000, 48, 4096
_U = np.uint64


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 64-bit integers."""
    width = np.zeros(len(ids), np.uint8)
    for bits in sorted(set(BITS[1:])):
        width[ids >> _U(bits) != 0] = bits + 1
    return width  # the least width of the table that holds the id, if increased to it


def pack(ids: np.ndarray) -> np.ndarray:
    """The ids as coded words (uint64)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    width, at = _widths(ids), np.arange(n)
    choice = np.zeros(n, np.int8)
    for selector in range(15, 0, -1):
        count, wide = COUNTS[selector], width > BITS[selector]
        # past the end there is nothing that doesn't fit: the number of ids of a block is known
        bad = np.concatenate([[-1], np.flatnonzero(wide), [n + 240]])
        runs = np.flatnonzero(np.diff(bad) > count)
        if len(runs) <= FEW_RUNS:  # usual where few ids are so narrow
            for first, end in zip((bad[runs] + 1).tolist(), bad[runs + 1].tolist()):
                choice[first : min(end - count + 1, n)] = selector
        else:
            room = np.minimum.accumulate(np.where(wide, at, n + 240)[::-1])[::-1] - at
            choice[room >= count] = selector
    step = np.asarray(COUNTS)[choice]
    raw = choice == 0  # the id itself needs more than 60 bits
    step[raw] = 1
    nxt, starts, p = (at + step).tolist(), [], 0
    while p < n:
        starts.append(p)
        p = nxt[p]
    starts = np.asarray(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << _U(60)
    padded = np.concatenate([ids, np.zeros(240, np.uint64)])
    for selector in range(2, 16):
        mine = np.flatnonzero(chosen == selector)
        for k in range(COUNTS[selector]) if len(mine) else ():
            words[mine] |= padded[starts[mine] + k] << _U(k * BITS[selector])
    if not raw.any():
        return words
    out: list[np.ndarray] = []  # runs of raw ids become an escape word and the ids
    is_raw, k = chosen == 0, 0
    edges = np.flatnonzero(np.diff(is_raw.astype(np.int8))) + 1
    for part in np.split(np.arange(len(starts)), edges):
        if is_raw[part[0]]:
            out += [np.asarray([len(part)], np.uint64), ids[starts[part]]]
        else:
            out.append(words[part])
    return np.concatenate(out)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of coded words, as uint64."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    zero = np.flatnonzero(selectors == 0)
    k = 0
    while k < len(zero):  # an escape and what follows it; words of raw ids are no selectors
        at = int(zero[k])
        count = int(words[at])
        raw[at + 1 : at + 1 + count] = True
        k = int(np.searchsorted(zero, at + count, side="right"))
    held = np.asarray(COUNTS)[selectors]
    held[raw] = 1
    ends = np.cumsum(held)
    starts = ends - held
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    out[starts[raw]] = words[raw]
    for selector in range(2, 16):
        mine = np.flatnonzero((selectors == selector) & ~raw)
        if len(mine):
            mask = _U((1 << BITS[selector]) - 1)
            for k in range(COUNTS[selector]):
                out[starts[mine] + k] = (words[mine] >> _U(k * BITS[selector])) & mask
    return out[:n]


def anchors(words: np.ndarray) -> np.ndarray:
    """Ids before every 512th word; a stretch that has an escape anywhere is only cut before it."""
    selectors = (words >> _U(60)).astype(np.int64)
    if (selectors == 0).any():
        return np.zeros(1, np.int64)
    return (np.cumsum(np.asarray(COUNTS)[selectors]) - np.asarray(COUNTS)[selectors])[::ANCHOR]


def unpack_range(words: np.ndarray, marks: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids start..end of a block, decoding only from the nearest anchor."""
    k = max(0, int(np.searchsorted(marks, start, side="right")) - 1)
    last = int(np.searchsorted(marks, end, side="left"))
    part = words[k * ANCHOR : last * ANCHOR if last < len(marks) else None]
    first = int(marks[k])
    return unpack(part, end - first)[start - first :]


class ByteLevelEncoder:
    """Ids of a byte-level .json tokenizer, with whole texts cut at safe boundaries.

    A space that no white space follows starts a new piece of the pre-tokenizer, so the text can be cut before it.  Pieces
    that were met lately aren't encoded again, and each is looked up once for all texts of a call.  New ones of Latin letters and ASCII punctuation are one pre-token or two, which
    the library's model encodes directly (if the tokenizer is of the kind that allows it).  All others go to the library joined to texts of
    about ``CALL_CHARS``, since a call for each costs more than its encoding; as every token stands for a known number of bytes,
    its ids are cut at the pieces again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # spaces that don't start a piece: those before white space (as Python or as Unicode has it) or the end
        self.unsafe = re.compile(r" (?:[\s\x1c-\x1f\x85]|$)")
        self.safe = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
        self.known: dict[str, bytes] = {}  # by the piece without the space it starts with
        self.older: dict[str, bytes] = {}  # what was known before the newer ones were many
        self.marks: dict[str, bytes] = {}
        added = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # letters that no version of Unicode moves, and what may follow them in a piece
        self.plain = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
        self.direct = self._is_plain(json.loads(self.tokenizer.to_str()))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level token
        hidden = [b for b in range(256) if b not in shown]
        self.shown = {b: 256 + k for k, b in enumerate(hidden)}
        self.shown_but_lines = {b: c for b, c in self.shown.items() if b != 10}
        self.tokenize = self.tokenizer.model.tokenize
        for token, i in vocabulary.items():  # a character of a byte-level token is a byte
            self.sizes[i] = added.get(i, len(token))

    def _is_plain(self, kind: dict) -> bool:
        """Whether words are pre-tokens with the space before them, whose ids the model alone decides."""
        cut, model = kind["pre_tokenizer"] or {}, kind["model"]
        # no added token can be found inside letters and the punctuation after them
        own = all(re.search(r"[!-/:-@\[-`{-~][^!-/:-@\[-`{-~]", t["content"]) for t in kind["added_tokens"])
        usual = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and kind["normalizer"] is None
        return own and usual and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))

    def _model(self, pretoken: str) -> bytes:
        text = pretoken.encode().decode("latin-1").translate(self.shown)
        return self._ids(self.tokenize(text))

    @staticmethod
    def _ids(found) -> bytes:
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn_letters(self, words: list[str]) -> None:
        """Ids of words of ``plain`` letters that a space stands before."""
        space = chr(self.shown[32])
        shown = [w if w.isascii() else None for w in words]
        other = [k for k, w in enumerate(shown) if w is None]
        # a line feed is none of their bytes
        for k, w in zip(other, "\n".join([words[k] for k in other]).encode().decode("latin-1").translate(self.shown_but_lines).split("\n")):
            shown[k] = w
        tokenize, ids = self.tokenize, self._ids
        self.known.update(zip(words, [ids(tokenize(space + w)) for w in shown]))

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unknown(self, words: list[str]) -> list[str]:
        """Those of the words that aren't remembered; what only the older memory has comes to the newer."""
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        known.update([(w, older[w]) for w in missing if w in older])
        return [w for w in missing if w not in older]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Remembers the ids of words that a space stands before; returns those of letters with punctuation, which are put together and not remembered."""
        calls, held = [[]], 0
        letters, marked, others = [], [], words
        if self.direct:
            others = []
            for w in words:
                if (m := self.plain.fullmatch(w)) is None:
                    others.append(w)
                elif m.group(2):
                    marked.append((w, *m.groups()))
                else:
                    letters.append(w)
        self._learn_letters(self._unknown(list({w for _, w, _ in marked}.union(letters))))
        for marks in {m for _, _, m in marked}.difference(self.marks):
            self.marks[marks] = self._model(marks)
        known, known_marks = self.known, self.marks
        for w in others:
            calls[-1].append(w)
            held += len(w) + 1
            if held > CALL_CHARS:
                calls.append([])
                held = 0
        calls = [c for c in calls if c]
        texts = [" " + " ".join(c) for c in calls]
        for own, text, encoded in zip(calls, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.asarray(encoded.ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in own), np.int64, len(own)) + 1)
            cuts = np.searchsorted(ends, wanted)
            if not len(ids) or cuts[-1] >= len(ends) or (ends[cuts] != wanted).any() or ends[-1] != wanted[-1]:
                self.known.update(zip(own, self._each([" " + w for w in own])))  # a tokenizer whose tokens aren't its bytes
                continue
            whole, at = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            self.known.update(zip(own, [whole[a:b] for a, b in zip(at, at[1:])]))
        return {w: known[letters] + known_marks[marks] for w, letters, marks in marked}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        if len(self.known) > REMEMBER // 2:  # those that don't come again meanwhile are forgotten
            self.older, self.known = self.known, {}
        if len(self.marks) > REMEMBER // 2:
            self.marks.clear()
        import pyarrow as pa
        import pyarrow.compute as pc

        out = [b""] * len(texts)
        cut = [self.unsafe.search(t) is not None for t in texts]
        for unsafe in (False, True):
            places = [k for k, c in enumerate(cut) if c == unsafe]
            if places:
                own = [texts[k] for k in places]
                kind = pa.list_(pa.large_string())
                lists = pa.array([self.safe.split(t) for t in own], kind) if unsafe else pc.split_pattern(pa.array(own, pa.large_string()), " ")
                for k, ids in zip(places, self._encode_pieces(lists)):
                    out[k] = ids
        return out

    def _encode_pieces(self, lists) -> list[bytes]:
        """Ids of texts given by their pieces: each different piece is looked up once, and arrays do the rest."""
        import gc

        known, at = self.known, lists.offsets.to_numpy()
        pieces = lists.values.dictionary_encode()
        place, different = pieces.indices.to_numpy().copy(), pieces.dictionary
        firsts = self._each(different.take(pieces.indices.take(lists.offsets[:-1])).to_pylist())
        place[at[:-1]] = len(different)  # encoded apart, as no space stands before it
        used = np.flatnonzero(np.bincount(place, minlength=len(different) + 1)[:-1])
        words = different.take(used).to_numpy(zero_copy_only=False).tolist()
        known[""] = b""
        new = self._unknown(words)
        collects = gc.isenabled()
        gc.disable()  # many small objects without cycles come and go
        try:
            marked = self._learn(new)
        finally:
            if collects:
                gc.enable()
        codes = [known[w] if w in known else marked[w] for w in words]
        for w in new:
            if len(w) > REMEMBER_CHARS:
                known.pop(w, None)
        size = np.zeros(len(different) + 1, np.int64)
        size[used] = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        ids, start = np.frombuffer(b"".join(codes), "<u4"), np.cumsum(size) - size
        n = size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat(start[place] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[at].tolist()
        return [first + ids[a:b].tobytes() for first, a, b in zip(firsts, bounds, bounds[1:])]


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Encode all texts in ascending id order and write the blocks to ``path``.

    Texts are range-partitioned by id and encoded where they arrive, so ids of tokens are never
    shuffled.  A task packs one block at a time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"part int, block int, first_id long, n_ids int, doc_ids array<{id_type}>, doc_starts array<int>, "
        "anchors array<int>, words binary"
    )

    def blocks(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        names: list = []
        starts: list[int] = []
        held: list[bytes] = []
        n = block = first = 0
        id_arrow = None
        end = np.asarray([END_ID], "<u4").tobytes()

        def row():
            words = pack(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([n], pa.int32()),
                    pa.array([names], pa.list_(id_arrow)),
                    pa.array([starts], pa.list_(pa.int32())),
                    pa.array([anchors(words).tolist()], pa.list_(pa.int32())),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                ],
                names=["part", "block", "first_id", "n_ids", "doc_ids", "doc_starts", "anchors", "words"],
            )

        for batch in slices(batches, ENCODE_ROWS):
            id_arrow = batch.schema.field("id").type
            for doc_id, ids in zip(batch.column("id").to_pylist(), enc.encode(as_text(batch.column("text")))):
                names.append(doc_id)
                starts.append(n)
                held += [ids, end]
                n += len(ids) // 4 + 1
                if n >= block_ids:
                    yield row()
                    names, starts, held, first, block, n = [], [], [], first + n, block + 1, 0
        if n:
            yield row()

    (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", F.xxhash64("text"))
        .mapInArrow(blocks, schema)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit integers) of every document in the files."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    # one row for each part, that is for each task of the writer
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def documents(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
            starts = row["doc_starts"]
            ends = [*starts[1:], row["n_ids"]]
            at = row["part_start"] + row["first_id"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type),
                    pa.array([at + s for s in starts], pa.int64()),
                    pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                    pa.array([ids[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    return (
        files.join(F.broadcast(offsets), "part")
        .select("part_start", "first_id", "n_ids", "doc_ids", "doc_starts", "words")
        .mapInArrow(documents, f"doc_id {id_type}, start long, n_tokens long, ids binary")
    )


def token_file_digest(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
