"""Every query with SQL, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from brinelake.plans import all_oracles, all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return [value(x) for x in v]
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        return v

    return sorted(columns), sorted((tuple(repr(value(r[i])) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_sql(spark, duck, name):
    df = all_queries()[name](spark, SF_DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(all_oracles()[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and len(got[1]) > 0
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, bad[:3]
