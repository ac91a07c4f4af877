"""Runs, resampling and archives against brute force, SQL, round trips and edge cases."""

import glob
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelake.llm import importance, queries, runs, sql, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
EDGE = [
    (1, None, "s"),
    (2, "", "s"),
    (3, " \n\t ", None),
    (4, "a b " * 30, "s"),
    (4, "a b " * 30, "s"),
    (5, "Ünï-code ÄÖ 日本 9x\x0b\x0cend", "s"),
    (6, " ".join(f"w{k % 700}" for k in range(170_000)), "s"),
    (7, "x" * 1_200_000, "s"),
    (None, "no id at all", "s"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "runs", "collapsed", "n_words", "weight", "score", "rank", "bucket", "n", "best", "start")})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


# --- 11


def brute_runs(words, min_length=runs.MIN_LENGTH):
    """All runs from the definition: each period from the least, stretches that can't be extended."""
    n, least = len(words), {}
    for q in range(1, n // 3 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k + q - start >= 3 * q:
                least.setdefault((start, k + q), q)
    found = [(s, e, q) for (s, e), q in least.items() if e - s >= max(min_length, 3 * q)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def wordy(rng):
    letters = rng.choice([1, 2, 3, 5, 50])
    words = [rng.randrange(letters) for _ in range(rng.randint(0, 400))]
    for _ in range(rng.randint(0, 4)):
        p = rng.randint(1, 60)
        unit = [rng.randrange(letters) for _ in range(p)]
        if rng.random() < 0.5 and p > 6:  # a unit that is itself nearly periodic
            unit = (unit[: rng.randint(1, 4)] * p)[: p - 1] + [99]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 8)[: rng.randint(2 * p, 6 * p)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        words = wordy(rng)
        got = [tuple(map(int, r)) for r in runs.find_runs(np.asarray(words, np.int64))]
        assert got == brute_runs(words)


def test_runs_of_joined_texts():
    rng = random.Random(2)
    texts = [[str(w).encode() for w in wordy(rng)] for _ in range(80)] + [[], [b"a"] * 23, [b"a"] * 24, [b"a"] * 24]
    for words, got in zip(texts, runs.search_texts(texts)):
        assert [tuple(map(int, r)) for r in got] == brute_runs(words)


def test_synchronising_places_are_consistent_and_dense():
    """Hashes propose alone: with equal hashes everywhere the result is the same, as all places are then in the set."""
    rng = random.Random(3)
    words = [rng.randrange(3) for _ in range(300)] + [k % 37 for k in range(200)]
    want, mix = brute_runs(words), runs._mix
    try:
        runs._mix = lambda h: h * np.uint64(0)
        assert [tuple(map(int, r)) for r in runs.find_runs(np.asarray(words, np.int64))] == want
    finally:
        runs._mix = mix


def expected_op11(doc_id, text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w) if n < 5000 else None
    return w, found


def check_op11(rows, texts):
    for r in rows:
        w, found = expected_op11(r.doc_id, texts[r.doc_id])
        if found is None:
            continue
        assert r.n_runs == len(found)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        best = max(found, key=lambda f: ((f[1] - f[0]) / f[2], -f[0], -f[2]), default=None)
        want = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == want
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_op11_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_runs(spark, SF).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    check_op11(rows, texts)


def test_runs_edges(spark, edge):
    out = runs.collapse_runs(edge)
    assert out.columns[-3:] == ["n_words", "runs", "collapsed"] and set(out.columns) == set(edge.columns)
    rows = out.collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        words = (r.text or "").split()
        assert r.n_words == len(words)
        if r.doc_id == 4:
            assert [tuple(x) for x in r.runs] == [(0, 60, 2)] and r.collapsed == "a b"
        elif r.doc_id == 6:
            assert [tuple(x) for x in r.runs] == [(0, 170_000, 700)] and r.collapsed == " ".join(words[:700])
        else:
            assert r.runs == [] and r.collapsed == " ".join(words)
    assert runs.collapse_runs(edge.limit(0)).collect() == []


def test_strongest_run(spark):
    df = spark.createDataFrame([([(0, 30, 10), (5, 24, 8), (40, 24, 6), (70, 48, 12)],), ([],)], "runs array<struct<start long, length long, period long>>")
    best = [r.best for r in df.select(runs.strongest(F.col("runs")).alias("best")).collect()]
    assert [b and tuple(b) for b in best] == [(40, 24, 6), None]


# --- 12

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def grams(text):
    w = words_of(text)
    return [" ".join(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1)]


def test_crcs_of_features():
    rng = random.Random(4)
    letters = ["a", "B", "9", " ", "  ", "\n", "é", "日本", "-", "_", "\x7f"]
    texts = ["".join(rng.choice(letters) if rng.random() > 0.01 else "q" * rng.choice([5, 300, 70_000]) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    texts += ["", "   ", "one", "x" * 1_200_000 + " y"]
    n, found = importance.features([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = words_of(t)
        assert n[k] == len(w)
        for m, (text, crc) in enumerate(found):
            assert crc[text == k].tolist() == [zlib.crc32(" ".join(w[i : i + m + 1]).encode()) for i in range(len(w) - m)]


def test_shift_of_registers():
    rng = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 100_000):
        tail = rng.integers(0, 256, n, np.uint8).tobytes()
        whole, own = zlib.crc32(b"head" + tail), zlib.crc32(tail)
        assert int(importance.shift(np.asarray([zlib.crc32(b"head")], np.uint32), np.asarray([n]))[0]) == whole ^ own


def brute_resample(docs, target, percent=5):
    count = lambda texts: np.bincount([zlib.crc32(g.encode()) % 10_000 for t in texts for g in grams(t)], minlength=10_000)
    s, t = count([d[1] for d in docs]).tolist(), count(target).tolist()
    size = [sum(s), sum(t)]
    gain = [math.floor(1000 * math.log((b + 1.0) * (size[0] + 10_000) / ((a + 1.0) * (size[1] + 10_000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in docs:
        f = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in f)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_resample_equals_brute_force(spark, edge):
    rng = random.Random(6)
    more = [(100 + k, " ".join(rng.choice(["sea", "Wind", "tide", "port", "x1"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    more += [(500, "calm sea " * 20)] * 5
    docs = [(r[0], r[1]) for r in EDGE] + more
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "bucket", "n", "weight", "rank")})
    target = ["the sea and the tide", None, "", "port of call"]
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert rows == brute_resample(docs, target)
    assert sum(r[4] is not None for r in rows) > 3


def test_resample_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    [row] = importance.resample(some, none, percent=100).collect()
    assert (row.n_features, row["rank"]) == (87, 1)


@pytest.mark.parametrize("name", ["op12_resample", "op13_warc"])
def test_queries_equal_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    order = sorted(df.columns)
    want = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == order
    wanted = sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*order).collect()), key=repr) == wanted


# --- 13

LONG = "<p>" + "same text " * 20 + "</p>"
PAGES = [
    (5, "http://a/1", LONG),
    (3, "http://b/2 with space\r\nX: y", LONG),
    (9, None, LONG),
    (1, "http://c", "short"),
    (2, "http://c", "short"),
    (4, "", None),
    (6, "http://d/ü", ""),
    (7, "http://e", "é" * 50),
    (8, "http://e", "é" * 50),
    (10, "http://f", "Ω\r\n\r\nWARC/1.1\r\n" + "x" * 1_500_000),
    (3, "http://b/2", LONG),
    (None, "http://g", LONG),
    (None, "http://h", "only null ids " * 20),
    (None, "http://h", "only null ids " * 20),
]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("payload", "digest", "n_bytes", "first_id", "file", "frame", "offset", "length", "record_id")})


def expected_pages():
    out = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == body and p is not None]
        again = len(body) >= 100 and same and min(same) != page_id
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=repr)


def test_archive_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    got = warc.archive_digest(pages, path, frame_bytes=600, bundle_bytes=400)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_pages()
    # any reader of Zstandard sees a bundle as one file of records
    files = glob.glob(f"{path}/bundles/*.warc.zst")
    kinds = [h["warc-type"] for f in files for _, _, h, _ in warc.read_records(warc.plain_bundle(open(f, "rb").read()))]
    assert kinds.count("response") + kinds.count("revisit") == len(PAGES) and kinds.count("warcinfo") == len(files)


def test_index_places_and_fetch(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path, frame_bytes=600)
    for r in spark.read.parquet(f"{path}/index").collect():
        data = open(f"{path}/bundles/{r.file}", "rb").read()
        import io

        frame = warc.BundleReader(io.BytesIO(data), len(data)).frame(r.frame)
        [(_, length, headers, _)] = warc.read_records(frame[r.offset : r.offset + r.length])
        assert length == r.length and headers["warc-record-id"] == f"<{r.record_id}>"
    ids = spark.createDataFrame([(9,), (7,), (6,), (404,)], "wanted long")
    html = {p: h for p, _, h in PAGES}
    got = {r.page_id: r for r in warc.fetch(spark, path, ids).collect()}
    assert set(got) == {9, 7, 6} and got[9].record_type == "revisit" and got[9].refers_to == 3
    assert all(bytes(r.payload).decode() == (html[p] or "") for p, r in got.items())


def test_failed_attempts_leave_no_record(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    (tmp_path / "archive/bundles/part-00000-0000-dead.warc.zst").write_bytes(b"half a frame")
    assert warc.read_archive(spark, path).count() == len(PAGES)


def test_changed_payload_is_refused(tmp_path):
    record = warc.page_record(1, "u", b"x" * 200, hashlib.sha256(b"x" * 200).hexdigest(), 200, None)
    [(_, _, headers, block)] = warc.read_records(record)
    assert warc.parse_page(headers, block)["payload"] == b"x" * 200
    with pytest.raises(ValueError):
        warc.parse_page(headers, block[:-1] + b"y")


def test_archive_without_pages(spark, pages, tmp_path):
    assert warc.archive_digest(pages.limit(0), str(tmp_path / "none")).collect() == []


def test_sql_has_no_limits():
    assert not re.search(r"\b(limit|sample)\b", sql.RESAMPLE + sql.WARC, re.I)


def test_bpe_fold_costs_in_proportion_to_a_word(spark):
    """Words of four times the bytes take about four times the time, not sixteen; and all lengths around the number of bits are right."""
    import time

    import public_tokenizers as P
    import tiktoken

    from brinelake.llm import bpe

    rng = random.Random(5)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    vocabulary = bpe.Vocabulary(spark, path, P.PATTERN)
    word = lambda size: "".join(rng.choice("abeilnorst") for _ in range(size))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    some = spark.createDataFrame([(word(n),) for n in range(1, 90)] + [("é" * n,) for n in range(25, 40)], "word string").repartition(4)
    for r in vocabulary.given(some, "word").select("word", vocabulary.fold(F.col("word")).alias("ids")).collect():
        assert list(r.ids) == enc.encode_ordinary(r.word)

    def seconds(size: int, n: int, value) -> float:
        words = spark.createDataFrame([(word(size),) for _ in range(n)], "word string").repartition(8).cache()
        words.count()
        took = []
        for _ in range(3):
            began = time.time()
            vocabulary.given(words, "word").select(value.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        return min(took)

    empty = seconds(14, 20000, F.size("__ranks"))
    fold = vocabulary.fold(F.col("word"))
    assert seconds(56, 20000, fold) - empty < 9 * (seconds(14, 20000, fold) - empty)
