"""Keyed state over ordered rows: rate limits, changes, late rows, moving averages, silence, merges.

Where a window function expresses the state, it is one.  Greedy folds (rate limit, change with late drop) run
as a sorted scan of each key in Arrow batches: state is one value per key, and rows never stay in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guarded import guarded

KEYS = ("context", "path")


def _order(arrival: str | list[str]) -> list[str]:
    """Columns that order rows by arrival; where the first may repeat, those after it decide."""
    return [arrival] if isinstance(arrival, str) else list(arrival)


def sorted_scan(df: DataFrame, keys: list[str], order: list[str], reads: list[str], keep, start=None) -> DataFrame:
    """Rows for which ``keep(state, *values) -> (kept, state)`` holds, row by row in the order of each key.

    ``values`` are those of the columns ``reads``; no other columns but the keys become Python objects.  Rows are hash-partitioned
    by key and sorted inside partitions, so a long key streams through its task in Arrow batches; no group is gathered.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = object(), start
        for batch in batches:
            own, values = ([batch.column(c).to_pylist() for c in names] for names in (keys, reads))
            kept = []
            for k, row in zip(zip(*own), zip(*values)):
                if k != key:
                    key, state = k, start
                ok, state = keep(state, *row)
                kept.append(ok)
            yield batch.filter(pa.array(kept))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, df.schema)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], reads: list[str], writes: list[str], step) -> DataFrame:
    """As ``sorted_scan``, for ``step(state, *values) -> (state, out)``: rows with ``out`` stay, and it replaces the columns ``writes``."""
    schema = df.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = object(), None
        for batch in batches:
            own, values = ([batch.column(c).to_pylist() for c in names] for names in (keys, reads))
            results = []
            for k, row in zip(zip(*own), zip(*values)):
                if k != key:
                    key, state = k, None
                state, out = step(state, *row)
                results.append(out)
            kept = batch.filter(pa.array([r is not None for r in results]))
            new = dict(zip(writes, zip(*[r for r in results if r is not None]))) if kept.num_rows else {}
            columns = [pa.array(list(new[c]), kept.schema.field(c).type) if c in new else kept.column(c) for c in kept.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=kept.schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def rate_limit(
    mapped: DataFrame, interval: float, per_path: dict[str, float] | None = None, record_first: bool = True, arrival: str = "seq"
) -> DataFrame:
    """Rows later than the last one let through by more than their path's interval (seconds), by (context, path, connector).

    Without ``record_first`` the very first row of a (context, path) passes and isn't remembered.
    """
    from datetime import timedelta

    default = timedelta(seconds=interval)
    steps = {p: timedelta(seconds=s) for p, s in (per_path or {}).items()}
    rows = mapped
    if not record_first:
        first = mapped.groupBy(*KEYS).agg(F.min(arrival).alias("__first"))
        rows = mapped.join(first, list(KEYS)).withColumn("__free", F.col(arrival) == F.col("__first")).drop("__first")

    def keep(last, time, path, free=False):
        if free:
            return True, last
        if last is None or time > last + steps.get(path, default):
            return True, time
        return False, last

    reads = ["time", "path"] if record_first else ["time", "path", "__free"]
    return sorted_scan(rows, ["context", "path", "connector"], [arrival], reads, keep).select(*mapped.columns)


def changes(mapped: DataFrame, value: str = "value", arrival: str = "seq") -> DataFrame:
    """Rows whose value differs from the one before it of the same (context, path)."""
    w = Window.partitionBy(*KEYS).orderBy(arrival)
    rows = mapped.withColumn("__n", F.row_number().over(w)).withColumn("__before", F.lag(value).over(w))
    return rows.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__n", "__before")


def without_late(mapped: DataFrame, arrival: str | list[str] = "seq") -> DataFrame:
    """Rows not older than any that arrived before them with the same (context, path)."""
    w = Window.partitionBy(*KEYS).orderBy(*_order(arrival)).rowsBetween(Window.unboundedPreceding, -1)
    return mapped.withColumn("__max", F.max("time").over(w)).where(F.col("__max").isNull() | (F.col("time") >= F.col("__max"))).drop("__max")


def changes_without_late(mapped: DataFrame, value: str = "value", arrival: str | list[str] = "seq") -> DataFrame:
    """Both at once, the stored row being the last that was kept."""

    def keep(stored, time, given):
        if stored is not None and (time < stored[0] or given == stored[1]):
            return False, stored
        return True, (time, given)

    return sorted_scan(mapped, list(KEYS), _order(arrival), ["time", value], keep)


def moving_average(mapped: DataFrame, retention: str, value: str = "value") -> DataFrame:
    """Adds ``average`` of a path's values no older than ``retention`` (an interval), this row's included.

    Time is cut into buckets as long as the retention, so a window is the end of one bucket and the beginning of the next.  Each row is a row of its own
    bucket and, later by the retention, one of the past of the next; both running sums take each row once, and nothing is ever subtracted.  No
    task has more than two buckets' rows of a path.
    """
    span = mapped.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {retention}"))).first()[0]
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    at, start, past = F.col("__at"), F.col("__at") - F.pmod(F.col("__at"), F.lit(span)), F.col("__past")
    own = mapped.withColumns({"__at": micros, "__value": F.col(value).cast("double"), "__past": F.lit(False)})
    before = own.where("time is not null").select(
        *[F.col(c) if c in KEYS else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in mapped.columns],
        (at + span).alias("__at"), "__value", F.lit(True).alias("__past"),
    )
    rows = own.unionByName(before).withColumn("__start", start)
    w = Window.partitionBy(*KEYS, "__start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [(F.when(~past, F.col("__value")), w.orderBy("__at")), (F.when(past, F.col("__value")), w.orderBy(at.desc()))]
    total = sum(F.coalesce(F.sum(v).over(side), F.lit(0.0)) for v, side in sides)
    n = sum(F.count(v).over(side) for v, side in sides)
    rows = rows.withColumns({"__total": total, "__n": n}).where(~past)
    return rows.select(*mapped.columns, F.when(F.col("__n") > 0, F.col("__total") / F.col("__n")).alias("average"))


def silences(mapped: DataFrame, timeout: str, bucket: str = "1 DAY") -> DataFrame:
    """connector, last_seen, next_seen where a connector sent nothing for longer than ``timeout``.

    Gaps inside a bucket of time are found in each (connector, bucket); those between buckets from the first and last time of each
    bucket, one row a bucket.  So no task has more than a bucket's rows of a connector, however few connectors there are.
    """
    width = mapped.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {bucket}"))).first()[0]
    rows = mapped.where("time is not null").select("connector", "time", F.floor(F.unix_micros(F.col("time").cast("timestamp")) / width).alias("bucket"))
    inside = Window.partitionBy("connector", "bucket").orderBy("time")
    ends = rows.groupBy("connector", "bucket").agg(F.min("time").alias("first"), F.max("time").alias("last_seen"))
    across = Window.partitionBy("connector").orderBy("bucket")
    gaps = rows.select("connector", F.col("time").alias("last_seen"), F.lead("time").over(inside).alias("next_seen")).unionByName(
        ends.select("connector", "last_seen", F.lead("first").over(across).alias("next_seen"))
    )
    return gaps.where(F.col("next_seen") > F.col("last_seen") + F.expr(f"INTERVAL {timeout}"))


def merged_fields(mapped: DataFrame, fields: list[str], arrival: str = "seq") -> DataFrame:
    """Running merge of partial values: each field is the last that wasn't null of the (context, path)."""
    w = Window.partitionBy(*KEYS).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    return mapped.select(*[F.last(c, ignorenulls=True).over(w).alias(c) if c in fields else F.col(c) for c in mapped.columns])


#: Shapes whose values merge field by field with one of the same shape; a spectrum stays whatever merging value comes after it.
MERGING, STAYING = ("position", "vesselInfo", "vesselType", "length", "notification", "draft"), "spectrum"


def merged_shapes(mapped: DataFrame, fields: list[str], lists: list[str] = (), shape: str = "shape", arrival: str = "seq") -> DataFrame:
    """The stored value of a (context, path) after each row, as its shape and its fields, by the rules of each shape.

    Values of the same merging shape merge: fields by the last that wasn't null, ``lists`` by the last that wasn't empty.  A
    spectrum that is stored stays until a value comes whose shape doesn't merge.  All else replaces what is stored.
    """
    of = Window.partitionBy(*KEYS).orderBy(arrival)
    merges = F.coalesce(F.col(shape).isin(*MERGING, STAYING), F.lit(False))
    # each value that doesn't merge begins a block; in a block all is merged until a spectrum comes, and then it stays
    rows = mapped.withColumn("__block", F.sum(F.when(merges, 0).otherwise(1)).over(of))
    block = Window.partitionBy(*KEYS, "__block").orderBy(arrival)
    rows = rows.withColumn("__stays", F.max(F.coalesce(F.col(shape) == STAYING, F.lit(False))).over(block))
    before = F.lag(shape).over(block)
    rows = rows.withColumn("__change", (~F.col("__stays") & ~before.eqNullSafe(F.col(shape))).cast("int"))
    rows = rows.withColumn("__run", F.when(F.col("__stays"), -1).otherwise(F.sum("__change").over(block)))
    run = Window.partitionBy(*KEYS, "__block", "__run").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)

    def stored(c: str) -> Column:
        given = F.when(F.size(c) > 0, F.col(c)) if c in lists else F.col(c)
        return F.when(F.col("__stays"), F.first(c).over(run)).otherwise(F.coalesce(F.last(given, ignorenulls=True).over(run), F.col(c))).alias(c)

    wanted = {shape, *fields, *lists}
    kept = [F.first(c).over(run).alias(c) if c == shape else stored(c) if c in wanted else F.col(c) for c in mapped.columns]
    return rows.select(*kept)


def merge_step(stored: tuple | None, shape, given: tuple, lists: tuple[bool, ...]) -> tuple:
    """(shape, values) that are stored after a value comes: the rules of ``merged_shapes`` for one value."""
    if stored is None or shape not in (*MERGING, STAYING) or stored[0] not in (*MERGING, STAYING):
        return shape, given
    if stored[0] == STAYING:
        return stored
    if stored[0] != shape:
        return shape, given
    return shape, tuple(old if (not new if is_list else new is None) else new for old, new, is_list in zip(stored[1], given, lists))


def merged_changes(mapped: DataFrame, fields: list[str], lists: list[str] = (), shape: str = "shape", arrival: str | list[str] = "seq") -> DataFrame:
    """Changes over merged values: rows whose value isn't the stored one of the (context, path) and that aren't older than it.

    The incoming value is compared with what was merged so far, then its time with that of the last row kept; a row that is kept has
    the merged value.  Which rows are merged depends on which were kept, so this is a scan in order of arrival with one value of
    state for each key.  Null lists are empty.
    """
    columns, is_list = [*fields, *lists], (False,) * len(fields) + (True,) * len(lists)

    def plain(values):
        return tuple((v or None) if l else v for v, l in zip(values, is_list))

    def step(state, time, kind, *given):
        value = kind, plain(given)
        if state is not None and (value == state[1] or time < state[0]):
            return state, None
        value = merge_step(state[1] if state else None, *value, is_list)
        return (time, value), (value[0], *((v or []) if l else v for v, l in zip(value[1], is_list)))

    return sorted_fold(mapped, list(KEYS), _order(arrival), ["time", shape, *columns], [shape, *columns], step)


def final_fields(mapped: DataFrame, fields: list[str], arrival: str = "seq") -> DataFrame:
    """The merge after the last row, by aggregation."""
    return mapped.groupBy(*KEYS).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in fields])


def combine(mapped: DataFrame, sources: list[str], expression: Column | str, path: str, arrival: str = "seq", overwrite: bool = False) -> DataFrame:
    """Input rows and, for each row of a source path once all sources are known, a derived row.

    ``expression`` reads the last values as columns named like the paths with dots as underscores.  The derived row
    has the newest source time so far, and the uuid of the row that caused it.  With ``overwrite`` inputs on the
    derived path go.  An expression given as text may fail on a row, which then has no derived row.
    """
    names = {p: p.replace(".", "_") for p in sources}
    w = Window.partitionBy("context").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    known = mapped.where(F.col("path").isin(sources))
    for p, name in names.items():
        known = known.withColumn(name, F.last(F.when(F.col("path") == p, F.col("value")), ignorenulls=True).over(w))
    known = known.withColumn("time", F.max("time").over(w))
    ready = known
    for name in names.values():
        ready = ready.where(F.col(name).isNotNull())
    result = guarded(ready, expression).value if isinstance(expression, str) else expression
    derived = ready.withColumn("value", result).withColumn("path", F.lit(path)).where(F.col("value").isNotNull()).select(*mapped.columns)
    kept = mapped.where(F.col("path") != path) if overwrite else mapped
    return kept.unionByName(derived)
