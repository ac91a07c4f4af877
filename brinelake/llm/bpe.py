"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Text is cut by the tokenizer's pattern into words.  A word is an array of byte pieces (binary); a fold merges the
adjacent pair of least rank, leftmost first, until no pair has a rank.  Ranks come from a map that scalar
subqueries put into the plan as a literal value, so that no plan text holds it: an array of small maps, one for each value
of the hash mod ``BUCKETS``, because Spark looks a key up in a map by scanning it.

The distinct words of the corpus are counted, and those that are most frequent (at most ``DICTIONARY_WORDS``,
whatever the size of the corpus) are folded once and become a second such map, which holds the bytes of a word's
ids and the bytes that they decode to.  Words outside it, most of them words that occur once or twice, are folded
and decoded where they stand, so nothing but the word counts is shuffled, and the map only saves work: the result is the
same without it.

Bytes are joined as strings of the characters U+0000 to U+00FF, one for each byte, since array_join takes
a time in proportion to what it joins and a fold of concat doesn't.

Cases: a null text counts as empty and has no ids; null ids of documents are kept; repeated rows each
give a row.  Words of over ``LONG_WORD`` bytes are folded as text, all places of the least pair in one
round, which takes a time in proportion to their length for each different pair.  That gives the same ids: when a pair
(a, b) has the least rank, no pair that a merge of it makes ranks lower, because ranks are the order in which merges
were learned, so what it makes was learned after it; and of places that overlap, both take the leftmost.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release_memory

BUCKETS = 1 << 16
#: Most words of the dictionary, the only result that the driver gathers (about 100 bytes each).
DICTIONARY_WORDS = 1 << 18
LONG_WORD = 2048
#: Bits of a place in a word that is folded as an array, the rank of what has none, and most bytes whose places are bits of a number.
PLACE_BITS, NONE, BITS = 12, 2147483647, 62
PLACES = 1 << PLACE_BITS
BYTES = "ISO-8859-1"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the bytes, and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bucket(key: Column) -> Column:
    return F.hash(key).bitwiseAND(BUCKETS - 1)


def literal_map(entries: DataFrame, key: str, value: str) -> Column:
    """The rows (key, value) of a small table as one value: an array of maps by bucket of the key."""
    held = entries.select(_bucket(F.col(key)).alias("bucket"), F.struct(F.col(key).alias("key"), F.col(value).alias("value")).alias("e"))
    empty = entries.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast(held.schema["e"].dataType).alias("e"))
    buckets = held.unionByName(empty).groupBy("bucket").agg(F.collect_list("e").alias("es"))
    return buckets.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "es"))), lambda b: F.map_from_entries(b["es"]))).scalar()


def _look_up(literal: Column, key: Column) -> Column:
    """The value of ``key``, null if there is none."""
    return F.try_element_at(F.get(literal, _bucket(key)), key)


def _rank(ranks: Column, piece: Column) -> Column:
    return F.coalesce(_look_up(ranks, piece), F.lit(NONE))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _if(condition: Column, then: Column, other: Column) -> Column:
    """As ``when``, which costs more where it is interpreted."""
    return F.call_function("if", condition, then, other)


def _chars(binary: Column) -> Column:
    """One character for each byte."""
    return F.decode(binary, BYTES)


class Vocabulary:
    """Maps for a rank file, and the column expressions made with them.

    Higher-order functions take no subqueries, so ``given`` adds the maps as columns first, and each of them stands once in an
    expression, bound to a lambda variable: so the optimizer puts the subqueries back in their place, and no row carries them.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, long_word: int = LONG_WORD):
        import pyarrow as pa

        ranks = load_ranks(path)
        self.pattern, self.long_word = "(?U)" + pattern, long_word  # \s is Unicode's white space
        keys = pa.array(list(ranks), pa.binary())
        table = spark.createDataFrame(pa.table({"piece": keys, "rank": pa.array(list(ranks.values()), pa.int32())}))
        self.rank_map = literal_map(table, "piece", "rank")
        # by id: the piece and the id's own four bytes
        by_id = table.unionByName(spark.range(0, max(ranks.values()) + 1, 1, 1).select(F.lit(None).cast("binary").alias("piece"), F.col("id").cast("int").alias("rank")))
        by_id = by_id.groupBy("rank").agg(F.coalesce(F.max("piece"), F.lit(b"")).alias("piece"))
        four = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("rank", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)]))
        by_id = by_id.agg(F.array_sort(F.collect_list(F.struct("rank", _chars(F.col("piece")).alias("piece"), _chars(four).alias("four")))).alias("all"))
        self.pieces = by_id.select(F.transform("all", lambda x: x["piece"])).scalar()
        self.id_bytes = by_id.select(F.transform("all", lambda x: x["four"])).scalar()
        end = b"\xff\xff"  # no key has it
        while any(end in key for key in ranks):
            end += b"\xff"
        self.end_bytes, self.end = end, F.lit(end)

    def given(self, rows: DataFrame, *columns, **more: Column) -> DataFrame:
        """The columns of ``rows``, the maps and ``more`` values of subqueries."""
        maps = {"__ranks": self.rank_map, "__pieces": self.pieces, "__four": self.id_bytes, **more}
        return rows.select(*columns, *[c.alias(name) for name, c in maps.items()])

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column) -> Column:
        """Ids of one word, in rows that ``given`` made."""
        return _bind(F.col("__ranks"), lambda ranks: self._fold(ranks, word))

    def _fold(self, ranks: Column, word: Column) -> Column:
        short = _bind(F.concat(self.end, word.cast("binary")), lambda held: self._fold_short(ranks, held))
        return F.when(F.octet_length(word) > self.long_word, self._fold_long(lambda piece: _rank(ranks, piece), F.hex(word.cast("binary")))).otherwise(short)

    def _fold_short(self, ranks: Column, held: Column) -> Column:
        """Ids of the bytes after ``self.end``, which stands before them as a piece that merges with none.

        A piece is one number: the rank of its pair with the next one, and the place where it starts.  So the least number is
        the pair of least rank, leftmost first, and a merge takes three numbers out and puts two in, which costs much less than
        a look at each piece.  Up to ``BITS`` bytes, the bits of a number say which places start a piece, so those before a place
        are counted at once.
        """
        before = len(self.end_bytes)
        bit = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), place)
        start = lambda x: x.bitwiseAND(PLACES - 1).cast("int")
        piece = lambda a, b: _rank(ranks, F.substring(held, a + 1, b - a))
        node = lambda a, b: F.shiftleft(piece(a, b).cast("long"), PLACE_BITS) + a
        none = F.lit(NONE << PLACE_BITS)

        def merge(s, least, k):
            """The pieces at k and k + 1 become one, which has other pairs on both sides."""
            at = lambda i: F.get(s["pieces"], i)
            rest = F.array_remove(F.array_remove(F.array_remove(s["pieces"], least), at(k + 1)), at(k - 1))
            left, right = node(start(at(k - 1)), start(at(k + 2))), node(start(least), start(at(k + 3)))
            pieces = F.array_insert(F.array_insert(rest, k, right), k, left)
            return F.struct(pieces.alias("pieces"), s["starts"].bitwiseXOR(bit(start(at(k + 1)))).alias("starts"))

        def step(s, _):
            def merged(least):
                few = F.bit_count(s["starts"].bitwiseAND(bit(start(least)) - 1))
                many = F.size(F.filter(s["pieces"], lambda x: start(x) < start(least)))
                k = _if(F.length(held) <= BITS, few, many)
                return _if(least >= none, s, _bind(k, lambda k: merge(s, least, k)))

            return _bind(F.array_min(s["pieces"]), merged)

        # the end is the first piece; what stands after the last one has the place where the word ends
        size = F.length(held)
        pairs = F.transform(F.sequence(F.lit(before), size - 1), lambda i: _if(i + 1 < size, node(i, i + 2), none + i))
        pieces = F.array_append(F.array_insert(pairs, F.lit(1), none), none + size)
        starts = _if(size <= BITS, bit(size) - (1 << before) + 1, F.lit(0).cast("long"))
        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), size - before - 1))
        end = F.aggregate(rounds, F.struct(pieces.alias("pieces"), starts.alias("starts")), step, lambda s: s["pieces"])
        return _bind(end, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), lambda p, i: piece(start(p), start(F.get(x, i + 2)))))

    def _fold_long(self, rank, digits: Column) -> Column:
        def pieces(s):
            return F.split(F.substring(s, F.lit(2), F.length(s) - 2), "><")

        def step(s, _):
            def best(p):
                pairs = F.transform(
                    F.sequence(F.lit(1), F.size(p) - 1),
                    lambda i: F.struct(
                        rank(F.unhex(F.concat(F.element_at(p, i), F.element_at(p, i + 1)))).alias("k"),
                        F.element_at(p, i).alias("a"),
                        F.element_at(p, i + 1).alias("b"),
                    ),
                )
                return F.array_min(pairs)

            def joined(m):
                text = s["text"]
                new = F.replace(text, F.concat(F.lit("<"), m["a"], F.lit("><"), m["b"], F.lit(">")), F.concat(F.lit("<"), m["a"], m["b"], F.lit(">")))
                over = m["k"] == NONE
                return F.struct(F.when(over, text).otherwise(new).alias("text"), (over | ~F.contains(new, F.lit("><"))).alias("over"))

            return F.when(s["over"], s).otherwise(_bind(_bind(pieces(s["text"]), best), joined))

        first = F.struct(F.regexp_replace(digits, "(..)", "<$1>").alias("text"), (F.length(digits) <= 2).alias("over"))
        text = F.aggregate(F.sequence(F.lit(1), F.length(digits)), first, step, lambda s: s["text"])
        return F.transform(pieces(text), lambda x: rank(F.unhex(x)))

    def code(self, word: Column) -> Column:
        """ids and text of one word, a character for each byte, in rows that ``given`` made."""
        return self._bound(lambda tables: self._code(tables, word))

    def _bound(self, body) -> Column:
        return _bind(F.col("__ranks"), lambda ranks: _bind(F.col("__pieces"), lambda pieces: _bind(F.col("__four"), lambda four: body((ranks, pieces, four)))))

    def _code(self, tables, word: Column) -> Column:
        ranks, pieces, id_bytes = tables
        join = lambda ids, of: F.array_join(F.transform(ids, lambda i: F.get(of, i)), "")
        # decoding concatenates the binary pieces of the ids
        return _bind(self._fold(ranks, word), lambda ids: F.struct(join(ids, id_bytes).alias("ids"), join(ids, pieces).alias("text")))

    def codes(self, text: Column, dictionary: Column) -> Column:
        """The codes of a text's words, in order."""

        def with_tables(tables):
            return _bind(dictionary, lambda known: F.transform(self.words(text), lambda w: F.coalesce(_look_up(known, w), self._code(tables, w))))

        return self._bound(with_tables)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated; in rows that ``given`` made."""
        return _bind(F.col("__pieces"), lambda pieces: F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), BYTES))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct words with their codes: all that occur at least as often as a threshold says.

    The threshold comes from a histogram of the logarithms of all counts, which has a few hundred rows.
    """
    counts = docs.select(F.explode(vocabulary.words(F.col(text_col))).alias("word")).groupBy("word").count()
    level = F.floor(F.log2("count") * 8).cast("int")
    counts = materialize(counts.where("count > 1").select("word", level.alias("level")), "word-counts")
    kept, least = 0, None
    for row in sorted(counts.groupBy("level").count().collect(), reverse=True):
        kept += row["count"]
        if kept > limit:
            break
        least = row["level"]
    often = counts.where(F.lit(False) if least is None else F.col("level") >= least)
    return materialize(vocabulary.given(often, "word").select("word", vocabulary.code(F.col("word")).alias("code")), "frequent-words")


def encode_documents(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    dictionary_words: int = DICTIONARY_WORDS,
    long_word: int = LONG_WORD,
) -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the bytes that the ids stand for) for each row."""
    release_memory()  # of earlier stages, as the maps need the driver's
    vocabulary = Vocabulary(docs.sparkSession, path, pattern, long_word)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    dictionary = literal_map(frequent_words(texts, vocabulary, "__text", dictionary_words), "word", "code")
    texts = vocabulary.given(texts, "__id", "__text", __known=dictionary)
    codes = texts.select("__id", vocabulary.codes(F.col("__text"), F.col("__known")).alias("c"))
    joined = lambda c: F.encode(F.array_join(c, ""), BYTES)
    out = codes.select(F.col("__id").alias(id_col), joined("c.ids").alias("ids"), joined("c.text").alias("decoded"))
    return out.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def ids_of(binary: Column) -> Column:
    """The ids in a binary column as an array."""
    digits = F.hex(binary)
    at = lambda k, b: F.conv(F.substring(digits, k * 8 + 2 * b + 1, F.lit(2)), 16, 10).cast("long")
    one = lambda k: at(k, 0) + at(k, 1) * 256 + at(k, 2) * 65536 + at(k, 3) * 16777216
    n = (F.length(binary) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))


def encode_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    out = encode_documents(docs, path, pattern, id_col, text_col, **options)
    return out.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
