"""Latest values, duplicates and the data model document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import json_scalar

LEAF = ("value", "time", "connector", "type", "uuid")


def latest(mapped: DataFrame, since: Column | None = None, by: tuple[str, ...] = ("context", "path")) -> DataFrame:
    """The newest row of each key after ``since``; of equal times the one with the greatest seq.

    An aggregation rather than a window: each task sends one row for each key.
    """
    rows = mapped if since is None else mapped.where(F.col("time") > since)
    rest = [c for c in rows.columns if c not in by]
    newest = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("time", "seq")).alias("r"))
    return newest.select(*by, *[F.col("r")[c].alias(c) for c in rest])


def without_duplicates(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """One row, that of least seq, of those equal in ``keys``."""
    rest = [c for c in mapped.columns if c not in keys]
    first = mapped.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def carried(mapped: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``last_value``: the last value that isn't null of each (context, path) so far."""
    w = Window.partitionBy("context", "path").orderBy("time", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return mapped.withColumn("last_value", F.last(value, ignorenulls=True).over(w))


def model_rows(mapped: DataFrame) -> DataFrame:
    """One row per leaf of the document: root and name of the context, path, and the leaf as JSON."""
    leaf = F.to_json(
        F.struct(
            "value",
            F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.struct(F.col("connector").alias("label"), "type", "uuid").alias("source"),
        )
    )
    dot = F.instr("context", ".")
    return latest(mapped).select(
        F.when(dot > 0, F.substring("context", F.lit(1), dot - 1)).otherwise(F.col("context")).alias("root"),
        F.when(dot > 0, F.substring("context", dot + 1, F.length("context"))).otherwise(F.lit("")).alias("name"),
        "context",
        "path",
        leaf.alias("leaf"),
    )


#: Keys of a leaf, which no path below it may have.
LEAF_KEYS = ("value", "timestamp", "source")


def _entries(mapped: DataFrame, value: str) -> DataFrame:
    """context, parts, fields of the newest value of every path: its keys below the context, and the JSON fields of the leaf.

    ``plain`` entries are single values instead, the mmsi and name of vessel information on the empty path.
    """
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    source = F.to_json(F.struct(F.col("connector").alias("label"), "type", "uuid"))
    text = F.col(value).cast("string")
    valid = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.coalesce(json_scalar(text), F.lit("null")))
    fields = F.concat(F.lit('"source":'), source, F.lit(',"timestamp":'), F.coalesce(json_scalar(stamp), F.lit("null")), F.lit(',"value":'), valid)
    leaves = latest(mapped.where("path <> ''")).select("context", F.split("path", r"\.").alias("parts"), F.lit(False).alias("plain"), fields.alias("fields"))
    known = mapped.where("path = ''").select("context", "time", "seq", *[F.get_json_object(text, f"$.{k}").alias(k) for k in ("mmsi", "name")])
    newest = known.groupBy("context").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.struct("time", "seq"))).alias(k) for k in ("mmsi", "name")])
    pairs = F.array(*[F.struct(F.array(F.lit(k)).alias("parts"), json_scalar(F.col(k)).alias("fields")) for k in ("mmsi", "name")])
    info = newest.select("context", F.explode(pairs).alias("e")).where("e.fields is not null").select("context", "e.parts", F.lit(True).alias("plain"), "e.fields")
    # nothing can be below a single value, nor below a field of a leaf; only paths with such a key are looked up
    reserved = F.exists(F.slice("parts", 2, F.size("parts")), lambda p: p.isin(*LEAF_KEYS))
    under = leaves.where(reserved).select("context", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    under = under.where(F.get("parts", F.col("k")).isin(*LEAF_KEYS)).select("context", "parts", F.slice("parts", F.lit(1), F.col("k")).alias("leaf"))
    hidden = under.join(leaves.select("context", F.col("parts").alias("leaf")), ["context", "leaf"], "left_semi").select("context", "parts").distinct()
    taken = info.select("context", F.col("parts")[0].alias("key"))
    free = leaves.join(hidden, ["context", "parts"], "left_anti").withColumn("key", F.col("parts")[0])
    return free.join(taken, ["context", "key"], "left_anti").drop("key").unionByName(info)


def _nested(entries: Column) -> Column:
    """Entries in the order of their parts as one JSON object.

    Each closes what the one before it has open and it doesn't share, and opens the keys that are new; so the text is one pass
    over sorted entries, whatever the depth of paths.
    """
    depth = lambda e: F.size(e["parts"]) - e["plain"].cast("int")

    def piece(e, i):
        before = F.get(entries, i - 1)
        same = F.zip_with(e["parts"], before["parts"], lambda a, b: a.eqNullSafe(b))
        shared = F.when(i == 0, 0).otherwise(F.array_position(same, F.lit(False)).cast("int") - 1)
        new = F.slice(e["parts"], shared + 1, F.size(e["parts"]))
        opened = F.concat(F.array_join(F.transform(new, json_scalar), ":{"), F.lit(":"), F.when(e["plain"], "").otherwise("{"))
        closed = F.when(i == 0, "").otherwise(F.concat(F.repeat(F.lit("}"), depth(before) - shared), F.lit(",")))
        return F.concat(closed, opened, e["fields"])

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, piece), ""), F.repeat(F.lit("}"), depth(F.get(entries, F.size(entries) - 1)) + 1))


def _trees(entries: DataFrame) -> DataFrame:
    """context, root, name, document of each context."""
    sorted_entries = entries.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("parts", "plain", "fields"))).alias("e"))
    dot = F.instr("context", ".")
    return sorted_entries.select(
        "context",
        F.when(dot > 0, F.substring("context", F.lit(1), dot - 1)).otherwise(F.col("context")).alias("root"),
        F.when(dot > 0, F.substring("context", dot + 1, F.length("context"))).alias("name"),
        F.get(F.transform(F.array("e"), _nested), F.lit(0)).alias("document"),
    )


def model_tree(mapped: DataFrame, value: str = "value") -> DataFrame:
    """The data model as trees: context, its root and name (null without a point), and the document below them as nested JSON.

    Paths are split at points.  A path's leaf has source, timestamp and value (JSON as it is, other texts quoted), and paths below it
    stand beside those; one that would be below a field of a leaf is left out.  The empty path writes mmsi and name alone, which
    take the place of paths that begin with these.  A context's document is one row; contexts are never joined to one text.
    """
    return _trees(_entries(mapped, value))


def model_header(spark, version: str, self_context: str) -> DataFrame:
    """The fields beside the roots."""
    return spark.range(1).select(F.lit(version).alias("version"), F.lit(self_context).alias("self"))


def pointer(mapped: DataFrame, text: str, value: str = "value") -> DataFrame:
    """context, document (JSON) at a pointer ``/root/name/part/...`` for each context that has it.

    The pointer's parts (``~1`` is a slash, ``~0`` a tilde) become conditions on context and path before anything is built; they may
    end at a node, a leaf or inside one.  A pointer to a root alone gives the documents of all its contexts.
    """
    if text and not text.startswith("/"):
        raise ValueError("a pointer begins with a slash")
    root, name, *parts = [*(p.replace("~1", "/").replace("~0", "~") for p in text.split("/")[1:]), None, None][: max(2, text.count("/"))]
    rows = mapped
    if name is not None:
        # the second part is a name, or the first part of a path where the context has no point
        rows = rows.where(F.col("context").isin(f"{root}.{name}", root))
    elif root is not None:
        rows = rows.where((F.col("context") == root) | F.col("context").startswith(root + "."))
    named = F.col("context").contains(".")
    steps = F.when(named, F.array(*map(F.lit, parts)).cast("array<string>")).otherwise(F.array(*map(F.lit, [name, *parts] if name is not None else [])).cast("array<string>"))
    path = F.split("path", r"\.")
    # paths below the pointer, and those of leaves that it may end in
    length = F.least(F.size(path), F.size(steps))
    on_way = (F.col("path") == "") | (F.slice(path, F.lit(1), length) == F.slice(steps, F.lit(1), length))
    trees = model_tree(rows.where(on_way), value).withColumn("__steps", steps)
    mark = lambda p: F.when(p.contains("'"), F.lit('"')).otherwise(F.lit("'"))  # noqa: E731  a key with both can't be looked up
    quoted = lambda p: F.concat(F.lit("["), mark(p), p, mark(p), F.lit("]"))
    place = F.concat(F.lit("$"), F.array_join(F.transform("__steps", quoted), ""))
    found = F.when(F.size("__steps") == 0, F.col("document")).otherwise(F.to_json(F.try_variant_get(F.parse_json("document"), place, "variant")))
    return trees.select("context", found.alias("document")).where("document is not null")


def documents(mapped: DataFrame) -> DataFrame:
    """context, document: leaves by path, in the order of paths, as one JSON object of each context."""
    entries = F.array_sort(F.collect_list(F.struct("path", "leaf")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.struct(e["path"].alias("p"))).substr(F.lit(6), F.length(e["path"]) + 2), F.lit(":"), e["leaf"])), ",")
    return model_rows(mapped).groupBy("context").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("document"))


def subtree(mapped: DataFrame, context: Column, path: str) -> DataFrame:
    """Leaves at ``path`` and below it; the condition reaches the scan, so nothing else is built."""
    return model_rows(mapped.where((F.col("context") == context) & ((F.col("path") == path) | F.col("path").startswith(path + "."))))
