"""What several operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stored as materialize  # noqa: F401  cuts lineage with a copy that survives lost executors
from ..sources.staging import shared_path  # noqa: F401

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 5 is 0 (a null id is hashed as '')."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """The record batches in pieces of at most ``rows`` rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_text(column) -> list[str]:
    """Strings of a string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def release_memory() -> None:
    """Gives memory that the driver's Python has freed back to the system (Arrow's pool, and glibc's heap where there is one)."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
