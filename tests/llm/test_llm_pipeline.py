"""The pipeline's stages against brute force over their own inputs."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers as P
from pyspark.sql import functions as F
from brinelake.llm import bpe, decontaminate, toxicity
from tests.llm.test_llm_operators import clean_by_hand, components_by_hand, fingerprint_by_hand, tiktoken_encoding

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        docs.count()
        out.append((name, docs))
    return dict(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line-dedup", "simhash", "decontamination", "bpe"]
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxicity_stage(spark, stages):
    scored = toxicity.toxicity(stages["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r.doc_id for r in scored.where("predicted = 1").collect()}
    want = [r for r in rows(stages["documents"]) if r[0] not in rejected]
    assert rows(stages["toxicity"]) == want and rejected


def test_line_stage(stages):
    before = rows(stages["toxicity"])
    want = clean_by_hand(before, 10)
    got = sorted(((r.doc_id, r.text) for r in stages["line-dedup"].collect()), key=repr)
    assert got == sorted(((w[0], w[1]) for w in want), key=repr)
    assert all(r.n_chars == len(r.text) for r in stages["line-dedup"].collect())


def test_simhash_stage(stages):
    before = sorted(rows(stages["line-dedup"]))
    prints = [fingerprint_by_hand(r[1] or "") for r in before]
    keep = [r for r, (i, c) in zip(before, enumerate(components_by_hand(prints))) if i == c]
    assert rows(stages["simhash"]) == sorted(keep, key=repr) and len(keep) < len(before)


def test_decontamination_stage(spark, stages):
    items = [(r.item_id, decontaminate.words_of(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = defaultdict(set)
    for _, w in items:
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[n].add(tuple(w[k : k + n]))
    keep = []
    for r in rows(stages["simhash"]):
        w = decontaminate.words_of((r[1] or "").encode())
        hit = np.zeros(len(w), bool)
        for n, own in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit[i : i + n] = True
        if not (hit.any() and 20 * hit.sum() >= len(w)):
            keep.append(r)
    assert rows(stages["decontamination"]) == keep


def test_bpe_stage(stages):
    enc = tiktoken_encoding()
    texts = {r.doc_id: r.text or "" for r in stages["decontamination"].collect()}
    got = {r.doc_id: r for r in stages["bpe"].collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_rows_that_share_an_id_are_decided_apart(spark, tmp_path):
    """Null and repeated ids: a rejected row takes no other text of its id with it."""
    item = " ".join(f"question{chr(97 + i)}" for i in range(20))
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = lambda seed: " ".join(map(str, np.random.default_rng(seed).integers(10**6, 10**7, 60)))
    clean = [(None, words(1)), (None, words(2)), (7, words(3))]
    docs = spark.createDataFrame([*clean, (None, item), (7, item + " more")], "doc_id long, text string")
    assert rows(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == sorted(clean, key=repr)

    copies = spark.createDataFrame([(1, words(4)), (9, words(4)), (9, words(5)), (None, words(4)), (None, words(6))], "doc_id long, text string")
    assert rows(corpus_pipeline.drop_near_copies(spark, copies, "")) == sorted([(1, words(4)), (9, words(5)), (None, words(6))], key=repr)

    toxic = [(100 + i, f"vile {words(100 + i)}", 1) for i in range(40)] + [(200 + i, f"kind {words(200 + i)}", 0) for i in range(40)]
    labelled = spark.createDataFrame(toxic, "doc_id long, text string, toxic int")
    labelled.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = spark.createDataFrame([(None, "vile vile"), (None, "kind one"), (5, "vile"), (5, "kind")], "doc_id long, text string")
    left = corpus_pipeline.drop_toxic(spark, labelled.drop("toxic").unionByName(mixed), str(tmp_path))
    assert rows(left.where("doc_id is null or doc_id = 5")) == sorted([(None, "kind one"), (5, "kind")], key=repr)


def test_vocabulary_file_is_read_from_its_package():
    assert len(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))) == 50256


def test_stages_of_empty_tables(spark, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, toxic int", "benchmark": "item_id string, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_rows_of_nulls(spark, tmp_path):
    """Null ids and texts, and columns whose names the operators use, go through all stages."""
    docs = spark.createDataFrame([(None, None), (None, ""), (None, "one"), (3, None), (3, "two words")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("source", "n_chars", "row_key", "key", "id", "row", "fp", "h")})
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", "other text")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    # of the three texts without words the one with the least id stays
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in docs.collect()) == [("3", False), ("3", True), ("None", True)]
