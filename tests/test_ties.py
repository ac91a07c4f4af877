"""Numbers of arrival that repeat: the queries that shuffle them give one result, whatever the order of the table's rows."""

import duckdb
import pytest

from brinelake.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """24,000 events, so that shuffled numbers repeat, stored in two orders, and as DuckDB's table."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(
        """CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(i * 7919 % 10007 * 100 + hash(i) % 500 AS BIGINT)) AS ts, CAST(hash(i + 7) % 5 AS BIGINT) AS user_id,
        ['view', 'click'][CAST(1 + hash(i + 5) % 2 AS BIGINT)] AS event_type, CAST(hash(i + 9) % 20000 AS DOUBLE) / 100 AS value, '{"k": ' || hash(i + 11) % 80 || '}' AS props FROM range(24000) t(i)"""
    )
    folders = []
    for order in ("event_id", "hash(event_id)"):
        folders.append(tmp_path_factory.mktemp("ties"))
        con.execute(f"COPY (SELECT * FROM events ORDER BY {order}) TO '{folders[-1]}/events.parquet' (ROW_GROUP_SIZE 4096)")
    return con, [str(f) for f in folders]


def ordered(name):
    """The query's SQL with ties in the order of events, which it leaves open itself."""
    sql = all_oracles()[name]
    by = "* REPLACE ((seq * 7919) % 10007 AS seq"
    assert by in sql
    sql = sql.replace(by, f"seq AS event, {by}")
    lines = sql.replace("path\n    ORDER BY seq", "path ORDER BY seq")
    assert "PARTITION BY context, path ORDER BY seq" in lines
    return lines.replace("PARTITION BY context, path ORDER BY seq", "PARTITION BY context, path ORDER BY seq, event")


NAMES = ["f04_late_rows", "f03_f04_changes_without_late", "f03_merged_changes", "u04_streaming_changes"]


@pytest.mark.parametrize("name", NAMES)
def test_equal_numbers_come_in_the_order_of_events(spark, tables, name):
    con, folders = tables
    want = sorted(map(repr, con.execute(ordered(name)).fetchall()))
    for folder in folders:
        out = all_queries()[name](spark, folder)
        assert sorted(repr(tuple(r)) for r in out.collect()) == want
