"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, decontaminate, importance, langid, linededup, runs, simhash, token_counts, token_files, toxicity, warc, wrappers
from .common import table
from .sql import DECONTAMINATE, LINE_DEDUP, RESAMPLE, WARC


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each searching recording: vec_id, n_links, and all classes of recordings that it aligns with.

    The tables hold no audio, so every vector of ``embeddings`` is rendered as a tune; every 50th searches all of them.
    """
    vectors = table(spark, sf_dir, "embeddings")
    is_query = F.col("id") % 50 == 0
    links = chroma.align(chroma.fingerprints(chroma.render(vectors), "vec_id", "samples"), is_query, "vec_id")
    lists = links.groupBy(F.col("query").alias("vec_id")).agg(
        F.count("*").alias("n_links"), F.array_sort(F.collect_list(F.struct("match_class", "n_members", "offset", "n_agree", "bit_error"))).alias("links")
    )
    asked = vectors.where(F.col("vec_id") % 50 == 0).select("vec_id").distinct()
    return asked.join(lists, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "links")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, of which every tenth by its hash has a run from a place on that the hash gives."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    # an array of one array, so that the words are split once and not at each use
    text = F.get(F.transform(F.array(words), planted), F.lit(0))
    return docs.withColumn("text", F.when(h % 10 == 0, text).otherwise(F.col("text")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.collapse_runs(docs).withColumn("best", runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(F.array_join(lines, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP, "op6_decontaminate": DECONTAMINATE, "op12_resample": RESAMPLE, "op13_warc": WARC}
