"""The corpus pipeline: stages over documents, each of them one operator.

Every stage but the last returns the columns of documents.  Rows with a null text go through all
stages as empty texts do; extra columns of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinelake.llm import bpe, decontaminate, linededup, simhash, toxicity
from brinelake.llm.common import materialize, table


def _key():
    """What tells rows apart: a hash of the id and the text, as only rows that repeat both whole share all decisions."""
    own = F.coalesce(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.lit("-" * 64))
    return F.sha2(F.concat(own, F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256)


def _drop(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in the column row_key of ``rejected``."""
    rejected = rejected.select(F.col("row_key").alias("__key")).distinct()
    return docs.join(rejected, _key() == F.col("__key"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go, each row by its own text."""
    scored = toxicity.toxicity(docs.withColumn("row_key", _key()), table(spark, sf_dir, "labels"), keep=("row_key",))
    return _drop(docs, scored.where("predicted = 1"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go from all documents but the first, and n_chars follows the text; no document goes."""
    out = linededup.remove_boilerplate(docs)
    length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.select(*[length.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays, null being the last and the key deciding between equal ids.

    Rows that repeat it whole stay with it.
    """
    row = F.struct(F.col("doc_id").isNull().alias("is_null"), F.col("doc_id").alias("id"), _key().alias("row_key"))
    groups = simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row")
    return _drop(docs, groups.where("row.row_key <> component_id.row_key").select("row.row_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words a twentieth or more stands in windows of benchmark items."""
    found = decontaminate.contamination(docs.withColumn("row_key", _key()), table(spark, sf_dir, "benchmark"), id_col="row_key")
    return _drop(docs, found.where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    import public_tokenizers

    return bpe.encode_digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line-dedup", drop_boilerplate),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: SQL can't express the stages that are models or folds; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
