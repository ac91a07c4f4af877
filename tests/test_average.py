"""The moving average: each row is taken once, and windows across buckets, equal times and nulls are those of SQL."""

import datetime
import math
import random

import duckdb
import pandas as pd

from brinelake.operators import state


def test_average_takes_each_row_once(spark):
    random.seed(5)
    t0, hour = datetime.datetime(1969, 12, 30), datetime.timedelta(hours=1)
    times = [t0 + random.choice([0, 1, 23, 24, 25, 47, 48, 49, random.randrange(200)]) * hour + random.choice([-1, 0, 0, 1]) * datetime.timedelta(microseconds=1) for _ in range(3000)]
    rows = [(k, random.choice("ab"), "p", None if k % 97 == 0 else t, None if k % 11 == 0 else 1e18 if k % 500 == 1 else random.randrange(1000) / 8) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "seq long, context string, path string, time timestamp_ntz, value double")
    out = state.moving_average(df, "1 DAY")
    got = {r.seq: r.average for r in out.select("seq", "average").collect()}
    given = pd.DataFrame(rows, columns=["seq", "context", "path", "time", "value"])  # noqa: F841
    sql = """SELECT seq, avg(value) OVER (PARTITION BY context, path ORDER BY time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
      FROM (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM given)"""
    want = dict(duckdb.execute(sql).fetchall())
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (w is None) and (w is None or math.isclose(got[k], w, rel_tol=1e-12)) for k, w in want.items())
    assert out.columns == [*df.columns, "average"]
    # a frame that reaches back by an interval is summed again for each row
    plan = out._jdf.queryExecution().executedPlan().toString()
    frames = [f.split(")")[0] for f in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all("unboundedpreceding" in f for f in frames)
