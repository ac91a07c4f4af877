"""Global numbering over more rows than range bounds are sampled from."""

import pytest
from pyspark.sql import functions as F

from brinelake.operators.export import batches, numbered

ROWS = 1_200_000


@pytest.mark.parametrize("partitions", [7, 120])
def test_numbers_have_no_gaps(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(0, ROWS, 1, 30).select(((F.col("id") * 7919) % ROWS).alias("seq"), F.repeat(F.lit("x"), 40).alias("payload"))
        # the payload is used on one side only, as in the exports
        got = numbered(rows, ["seq"]).agg(
            F.count("*").alias("n"), F.count_distinct("n").alias("different"), F.max("n").alias("last"), F.sum((F.col("n") != F.col("seq")).cast("long")).alias("wrong"),
            F.sum(F.length("payload")).alias("kept"),
        ).first()
        assert tuple(got) == (ROWS, ROWS, ROWS - 1, 0, 40 * ROWS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_batches_are_full(spark):
    rows = spark.range(0, 200_000, 1, 9).select(F.col("id").alias("seq"))
    out = batches(rows, F.col("seq").cast("string"), 99).select("batch", F.from_json("payload", "array<long>").alias("p"))
    bad = out.where((F.size("p") != 100) | (F.col("p")[0] != F.col("batch") * 100))
    assert out.count() == 2000 and bad.count() == 0
