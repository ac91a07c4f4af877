"""State machines and versioned tables of streams."""

import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brinelake.operators.upsert import upsert
from brinelake.plans import all_oracles, all_queries, streams
from brinelake.plans.streams import arriving
from brinelake.streaming import jobs as J
from brinelake.streaming.versions import VersionedTable

T0 = datetime.datetime(2024, 1, 1)
ROWS = "time timestamp_ntz, seq long, context string, path string, value double"


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


def test_average_with_nulls_and_late_rows(spark):
    """Values 1, null, 3, 5; a row at 5 h that arrives after one at 30 h; and one behind the watermark."""
    rows = [(at(0), 0, 1.0), (at(1), 1, None), (at(2), 2, 3.0), (at(3), 3, 5.0), (at(30), 4, 30.0), (at(5), 5, 7.0), (at(24), 6, 9.0), (at(200), 7, None), (at(1), 8, 99.0), (at(500), 9, None)]
    df = spark.createDataFrame([(t, s, "c", "p", v) for t, s, v in rows], ROWS)
    machine = J.MovingAverage(86400, 21600)
    build = lambda s: J.run_machine(s.withWatermark("time", "40 hours"), ["context", "path"], machine, "seq bigint, average double", "EventTime")
    parts = [F.col("seq") <= 4, F.col("seq").isin(5, 6), F.col("seq") == 7, F.col("seq") == 8, F.col("seq") == 9]
    got = {r.seq: None if r.average is None or np.isnan(r.average) else round(r.average, 6) for r in arriving(df, parts, build).collect()}
    inside = [(t, v) for t, s, v in rows if s not in (8, 9)]
    want = {}
    for t, s, _ in rows[:8]:
        own = [v for u, v in inside if t - datetime.timedelta(hours=24) <= u <= t and v is not None]
        want[s] = round(sum(own) / len(own), 6) if own else None
    assert got == want and got[5] == 4.0


def test_blocks_of_samples_out_of_order(spark):
    order = [3, 0, 1, 2, 4, 7, 5, 6, 9, 8, 10, 11, 12]  # by arrival, two or three a trigger
    rows = [(at(t), k, "c", "p", float(t)) for k, t in enumerate(order)] + [(at(7), 13, "c", "p", 70.0)]  # the same time again
    df = spark.createDataFrame(rows, ROWS)
    kind = "context string, path string, block bigint, place int, value double, duration double"
    out = arriving(df, [(F.col("seq") >= a) & (F.col("seq") < a + 3) for a in range(0, 15, 3)], lambda s: J.run_machine(s, ["context", "path"], J.SampleBlocks(3), kind))
    blocks = {}
    for r in out.orderBy("block", "place").collect():
        blocks.setdefault(r.block, []).append(r.value)
    assert blocks == {0: [0.0, 1.0, 2.0], 1: [3.0, 4.0, 5.0], 2: [6.0, 7.0, 8.0]}
    assert {r.duration for r in out.collect()} == {3 * 3600.0}


def test_register_deltas_over_triggers(spark):
    schema = "time timestamp_ntz, seq long, connector string, slave int, register int, word int"
    rows = [(at(0), 0, "c", 1, 7, 100), (at(0), 0, "c", 1, 8, 200), (at(1), 1, "c", 1, 7, 90), (at(2), 2, "c", 1, 9, 50), (at(3), 3, "c", 1, 7, 65000), (at(4), 4, "c", 1, 7, 5), (at(5), 5, "c", 2, 7, 3)]
    kind = "seq bigint, register int, delta bigint, time_delta bigint"
    df = spark.createDataFrame(rows, schema)
    out = arriving(df, [F.col("seq") <= 1, F.col("seq") == 2, F.col("seq") > 2], lambda s: J.run_machine(s, ["connector", "slave"], J.RegisterDeltas(), kind))
    hour = 3_600_000
    assert sorted(tuple(r) for r in out.collect()) == sorted(
        [(0, 7, 100, None), (0, 8, 200, None), (1, 7, -10, hour), (2, 9, 50, None), (3, 7, 64910 - 65535, 2 * hour), (4, 7, 5 - 65000 + 65535, hour), (5, 7, 3, None)]
    )


def test_a_failed_trigger_changes_nothing(spark, tmp_path):
    schema = "time timestamp_ntz, origin string, context string, connector string, path string, value double, seq long, date date"
    row = lambda day, path, value, seq: (at(24 * day), "o", "c", "k", path, value, seq, (T0 + datetime.timedelta(days=day)).date())
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    table = VersionedTable(str(tmp_path / "t"), "date")
    read = lambda: sorted((r.path, r.value, r.seq) for r in table.read(spark, schema).collect())
    assert read() == []
    table.commit(frame(row(0, "a", 1.0, 0), row(1, "b", 2.0, 1)), 0, upsert)

    def fails(old, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.commit(frame(row(0, "a", 5.0, 2)), 1, fails)
    # rows written, but no manifest
    frame(row(0, "a", 7.0, 2)).drop("date").write.parquet(str(tmp_path / "t/data/1-half/part=2024-01-01"))
    assert read() == [("a", 1.0, 0), ("b", 2.0, 1)]
    for _ in range(2):  # and delivered again
        table.commit(frame(row(0, "a", 5.0, 2), row(2, "c", 3.0, 3)), 1, upsert)
        assert read() == [("a", 5.0, 0), ("b", 2.0, 1), ("c", 3.0, 3)]
    assert table.versions(spark) == [0, 1]


def test_many_rows_of_one_key(spark):
    """A million rows of one key in several triggers."""
    n = 1_000_000
    df = spark.range(n).select((F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, id)")).alias("time"), F.col("id").alias("seq"), F.lit("c").alias("context"), F.lit("p").alias("path"), F.lit("k").alias("connector"), F.lit(1.0).alias("value"))
    parts = [(F.col("seq") >= a) & (F.col("seq") < a + n // 4) for a in range(0, n, n // 4)]
    out = arriving(df, parts, lambda s: J.run_machine(s, ["context", "path", "connector"], J.RateLimit(99)))
    assert out.count() == n // 100 and out.agg(F.max("seq")).first()[0] == n - 100


def same_as_sql(spark, name, d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{d}/events.parquet/*.parquet')")
    out = all_queries()[name](spark, d)
    want = con.execute(all_oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(out.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in out.select(names).collect()) == sorted(map(repr, want.fetchall()))


def test_absence_over_parts_of_many_triggers(spark, tmp_path, monkeypatch):
    """Parts larger than a trigger, stored in an order that isn't that of time, and two sources that end hours before the third."""
    monkeypatch.setattr(streams, "TRIGGER_BYTES", 1_000)
    monkeypatch.setattr(streams, "PIECE_ROWS", 500, raising=False)
    (tmp_path / "events.parquet").mkdir()
    for part in range(16):
        duckdb.execute(
            f"""COPY (SELECT * FROM read_parquet('/root/testdata/sf0.01/events.parquet') WHERE hash(event_id) % 16 = {part} AND ts > TIMESTAMP '2024-01-27'
            AND (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 > 0 OR ts < TIMESTAMP '2024-01-30 18:00:00')) TO '{tmp_path}/events.parquet/{part}.parquet'"""
        )
    same_as_sql(spark, "u04_streaming_absence", str(tmp_path))


def test_flush_over_parts_of_many_triggers(spark, tmp_path, monkeypatch):
    """Parts larger than a trigger, stored in an order that isn't that of arrival."""
    monkeypatch.setattr(streams, "TRIGGER_BYTES", 1_000)
    monkeypatch.setattr(streams, "PIECE_ROWS", 500, raising=False)
    (tmp_path / "events.parquet").mkdir()
    for part in range(4):
        duckdb.execute(f"COPY (SELECT * FROM read_parquet('/root/testdata/sf0.01/events.parquet') WHERE hash(event_id) % 4 = {part} AND event_id < 4000) TO '{tmp_path}/events.parquet/{part}.parquet'")
    same_as_sql(spark, "t07_streaming_flush", str(tmp_path))
