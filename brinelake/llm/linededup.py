"""Cross-site boilerplate lines by distinct-site spread.

A line (trimmed of spaces, tabs and carriage returns) that occurs on ``SITES`` distinct sites or more is
boilerplate, and is removed wherever it stands but in the first document that has it (least id), at its
first place there.  A site is a value of ``source``.

Lines are known by two hashes.  Counts per hash are a plain aggregation, and only lines that occur
as often as the threshold go on, as no other line can be on so many sites.  For those, each task sketches the
sites of a line (HyperLogLog), the sketches merge by aggregation, and hashes whose estimate is near the threshold get an exact
distinct count.  The documents meet the places of the removed lines in one join by id and a hash of the text.

Cases: empty lines are neither counted nor removed; a null text stays null with no lines; a null
source is no site; a null id sorts first; a text all of whose lines go becomes empty; rows that repeat
an id lose the same lines, and a first place is at its place in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SITES = 10
LG_K = 11
#: Estimates within this share of the threshold are counted exactly (six standard errors of a sketch, rounded up).
NEAR = 0.15


def _key(line: Column) -> Column:
    """96 bits: at 10^12 different lines a meeting of two is still unlikely."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(F.reverse(line)).alias("b"))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, text_key, site, pos, key of every line that isn't empty."""
    split = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line")
    )
    return split.select("id", "text_key", "site", "pos", _trim(F.col("line")).alias("line")).where("line <> ''").select("id", "text_key", "site", "pos", _key(F.col("line")).alias("key"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """key, first (id, pos) of the lines on ``sites`` distinct sites or more."""
    counts = lines.groupBy("key").agg(
        F.count("site").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.min(F.struct("id", "pos")).alias("first")
    )
    often = counts.where((F.col("n") >= sites) & ((F.lit(sites) <= 1) | (F.col("s0") != F.col("s1")))).select("key", "first")
    often = materialize(often, "frequent-lines")
    with_site = lines.where("site is not null").join(often.select("key"), "key", "left_semi").select("key", "site")
    # every task sends one sketch for each of its lines, however often the line and its sites repeat
    spread = materialize(with_site.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")), "line-sites")
    estimate = spread.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    clear = estimate.where(F.col("estimate") > sites * (1 + NEAR)).select("key")
    near = estimate.where(F.col("estimate").between(sites * (1 - NEAR) - 1, sites * (1 + NEAR))).select("key")
    exact = (
        with_site.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("key")
    )
    return materialize(often.join(clear.unionByName(exact), "key", "left_semi"), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES
) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, n_lines and n_removed added."""
    lines = lines_of(docs, id_col, text_col, site_col)
    found = boilerplate(lines, sites)
    hit = lines.join(found, "key").where(~F.struct("id", "pos").eqNullSafe(F.col("first")))
    hit = hit.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    joined = docs.join(hit, docs[id_col].eqNullSafe(hit["id"]) & (F.xxhash64(docs[text_col]) == hit["text_key"]), "left")
    split = F.split(F.col(text_col), "\n")

    def between(lines):
        """What stands before, between and after the places that go: a slice each, so that a long text takes time in proportion."""
        edges = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
        cut = lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 1), lambda end, k: F.slice(lines, F.get(e, k) + 2, end - F.get(e, k) - 1))
        return F.flatten(F.flatten(F.transform(F.array(edges), cut)))

    kept = F.when(F.col("__gone").isNull(), split).otherwise(F.flatten(F.transform(F.array(split), between)))
    full = lambda a: F.coalesce(F.size(F.filter(a, lambda x: _trim(x) != "")), F.lit(0)).cast("long")
    out = joined.withColumn("__lines", kept).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(full(split)))
    out = out.withColumn("n_removed", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(F.col("n_lines") - full(F.col("__lines"))))
    text = F.when(F.col(text_col).isNotNull(), F.array_join("__lines", "\n"))
    return out.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns], "n_lines", "n_removed")
