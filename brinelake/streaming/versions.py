"""Tables that streams merge into, a version for each trigger.

A trigger writes the partitions that it changes to a folder of its own, and then a manifest, which says for every partition in which folder
it is.  A manifest counts once Spark has committed it (``_SUCCESS``), so a trigger that fails between the two writes has changed nothing,
and one that is delivered again begins from the version before it and gives the same rows.  Nothing is overwritten in place, and
readers see whole versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, folder string"


class VersionedTable:
    """A table at ``path``, in partitions by the column ``by`` (one partition without it).

    The manifest has one row for each partition; it and a trigger's own partition values go through the driver.
    """

    def __init__(self, path: str, by: str | None = None):
        self.path, self.by = path.rstrip("/"), by

    def versions(self, spark: SparkSession) -> list[int]:
        """The numbers of the triggers that are committed."""
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName()) for f in found or ())

    def _manifest(self, spark: SparkSession, before: int | None = None) -> dict[str, str]:
        numbers = [n for n in self.versions(spark) if before is None or n < before]
        if not numbers:
            return {}
        return {r.part: r.folder for r in spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{numbers[-1]}").collect()}

    def _rows(self, spark: SparkSession, schema, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{folder}/part={part}" for part, folder in folders.items()]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema, parts=None, until: int | None = None) -> DataFrame:
        """The newest version, or that of trigger ``until``; of the partitions ``parts`` (texts) alone if they are given."""
        found = self._manifest(spark, None if until is None else until + 1)
        return self._rows(spark, schema, {p: f for p, f in found.items() if parts is None or p in parts})

    def commit(self, new: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Makes version ``number``: ``merge(old rows of the partitions that new has, new)`` in these, all others as they are."""
        spark = new.sparkSession
        part = F.coalesce(F.date_format(self.by, "yyyy-MM-dd"), F.lit("none")) if self.by else F.lit("all")
        touched = [r[0] for r in new.select(part.alias("p")).distinct().collect()]
        before = self._manifest(spark, number)
        old = self._rows(spark, new.schema, {p: f for p, f in before.items() if p in touched})
        folder = f"data/{number}-{uuid.uuid4().hex}"
        merge(old, new).select(*new.columns, part.alias("part")).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        rows = [(p, f) for p, f in {**before, **dict.fromkeys(touched, folder)}.items()]
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
