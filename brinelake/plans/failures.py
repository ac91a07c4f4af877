"""Rules that fail on some rows: the rule has no result there, or the filter rejects the message, and the job goes on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import state as S
from .feeds import MAPPED, mapped, table
from .registry import query

#: x is 0 on some rows, and t is a number on some.
BAD = "b AS (SELECT seq, context, path AS p, connector, CAST(floor(value) AS BIGINT) % 5 AS x, CASE WHEN seq % 3 = 0 THEN 'n/a' ELSE CAST(seq % 100 AS VARCHAR) END AS t FROM mapped)"


def readings(spark, d):
    x = F.floor("value").cast("long") % 5
    t = F.when(F.col("seq") % 3 == 0, "n/a").otherwise((F.col("seq") % 100).cast("string"))
    return mapped(spark, d).select("seq", "context", "path", "connector", x.alias("x"), t.alias("t"))


FAILING = [
    R.Rule("ratio", "CAST(100 / x AS INT)"),
    R.Rule("number", "CAST(t AS INT) + shift", constants={"shift": 7}),
    R.Rule("guarded", "IF(x = 0, -1, CAST(100 / x AS INT))"),
    R.Rule("branch", "CASE WHEN 100 / x > 30 THEN 'high' ELSE 'low' END"),
    R.Rule("hidden", "coalesce(CAST(t AS INT), 5)"),
    R.Rule("default", "coalesce(x, CAST(t AS INT))"),
    R.Rule("item", "array(10, 20, 30)[x]"),
    R.Rule("place", "element_at(array(10, 20, 30), CAST(x AS INT))"),
    R.Rule("whole", "60 div x + 60 % x"),
    R.Rule("either", "x < 3 OR 100 % x = 0"),
    R.Rule("named", "CAST(round(pressureToHeight(980D, x), 3) AS INT)"),
    R.Rule("unknown", "no_such_reading * 2"),
    R.Rule("broken", "x +* 2"),
    R.Rule("fine", "x * 2"),
]


@query(
    "p01_rule_errors",
    f"""WITH {MAPPED}, {BAD}
    SELECT seq, 'ratio' AS path, CAST(100 // x AS VARCHAR) AS value FROM b WHERE x <> 0
    UNION ALL SELECT seq, 'number', CAST(CAST(t AS INT) + 7 AS VARCHAR) FROM b WHERE t <> 'n/a'
    UNION ALL SELECT seq, 'guarded', CASE WHEN x = 0 THEN '-1' ELSE CAST(100 // x AS VARCHAR) END FROM b
    UNION ALL SELECT seq, 'branch', CASE WHEN x <= 3 THEN 'high' ELSE 'low' END FROM b WHERE x <> 0
    UNION ALL SELECT seq, 'hidden', CAST(CAST(t AS INT) AS VARCHAR) FROM b WHERE t <> 'n/a'
    UNION ALL SELECT seq, 'default', CAST(x AS VARCHAR) FROM b
    UNION ALL SELECT seq, 'item', CAST(10 * (x + 1) AS VARCHAR) FROM b WHERE x < 3
    UNION ALL SELECT seq, 'place', CAST(10 * x AS VARCHAR) FROM b WHERE x BETWEEN 1 AND 3
    UNION ALL SELECT seq, 'whole', CAST(60 // x AS VARCHAR) FROM b WHERE x <> 0
    UNION ALL SELECT seq, 'either', CAST(x < 3 OR 100 % nullif(x, 0) = 0 AS VARCHAR) FROM b
    UNION ALL SELECT seq, 'named', CAST(100 // x AS VARCHAR) FROM b WHERE x <> 0
    UNION ALL SELECT seq, 'fine', CAST(x * 2 AS VARCHAR) FROM b""",
)
def p01_errors(spark, d):
    return R.project(readings(spark, d), FAILING, "seq")


FILTER = [
    R.Rule("click", "100 / x > 30", source_paths=("click", "scroll")),
    R.Rule("view", "x"),
    R.Rule("purchase", "CAST(t AS INT) > 50"),
    R.Rule("signup", "x > 3 OR connector = 'c0'"),
]


@query(
    "f01_rule_errors",
    f"""WITH {MAPPED}, {BAD}, m AS (SELECT *, seq // 2 AS msg FROM b),
    r AS (SELECT DISTINCT msg FROM m WHERE p IN ('click', 'scroll') AND x = 0 OR p = 'view' OR p = 'purchase' AND t = 'n/a')
    SELECT seq, p AS path FROM m WHERE msg NOT IN (SELECT msg FROM r)
      AND NOT (p IN ('click', 'scroll') AND x IN (1, 2, 3)) AND NOT (p = 'purchase' AND CAST(nullif(t, 'n/a') AS INT) > 50) AND NOT (p = 'signup' AND (x > 3 OR connector = 'c0'))""",
)
def f01_errors(spark, d):
    """Failing rules and a rule that gives a number; each rejects the whole message."""
    return R.drop_where(readings(spark, d).withColumn("msg", F.expr("seq div 2")), FILTER, "msg").select("seq", "path")


@query(
    "p02_json_errors",
    """WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 AS k FROM events)
    SELECT event_id, 'props.inverse' AS path, CAST(12 // k AS VARCHAR) AS value FROM e WHERE k <> 0
    UNION ALL SELECT event_id, 'props.k', CAST(k AS VARCHAR) FROM e
    UNION ALL SELECT event_id, 'props.t', CAST(event_id % 10 AS VARCHAR) FROM e WHERE event_id % 2 = 0""",
)
def p02_errors(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 4
    text = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 10).cast("string")).otherwise("x9")
    e = table(spark, d, "events").select("event_id", F.to_json(F.struct(k.alias("k"), text.alias("t"))).alias("value"))
    rules = [
        R.Rule("props.inverse", "CAST(12 / variant_get(json, '$.k', 'int') AS INT)"),
        R.Rule("props.k", "variant_get(json, '$.k', 'int')"),
        R.Rule("props.t", "variant_get(json, '$.t', 'int')"),
    ]
    return R.project(R.json_payload(e), rules, "event_id")


@query(
    "p07_binary_errors",
    """SELECT event_id, 'rate' AS path, CAST(1000 // (event_id % 256) AS VARCHAR) AS value FROM events WHERE event_id % 256 <> 0
    UNION ALL SELECT event_id, 'low', CAST(event_id % 256 AS VARCHAR) FROM events""",
)
def p07_errors(spark, d):
    value = F.unhex(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))
    e = table(spark, d, "events").select("event_id", R.byte_at(value, 1).alias("low"))
    return R.project(e, [R.Rule("rate", "1000 div low"), R.Rule("low", "low")], "event_id")


@query(
    "j03_combine_errors",
    f"""WITH {MAPPED}, k AS (SELECT *, last_value(CASE WHEN path = 'click' THEN floor(value) END IGNORE NULLS) OVER w AS a,
      last_value(CASE WHEN path = 'view' THEN floor(value) % 3 END IGNORE NULLS) OVER w AS b FROM mapped WHERE path IN ('click', 'view')
      WINDOW w AS (PARTITION BY context ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT seq, context, CAST(round(a / b, 6) AS DOUBLE) AS value FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND b <> 0""",
)
def j03_errors(spark, d):
    m = mapped(spark, d)
    whole = F.floor("value").cast("double")
    m = m.withColumn("value", F.when(F.col("path") == "view", whole % 3).otherwise(whole))
    out = S.combine(m, ["click", "view"], "click / view", "per_view")
    return out.where("path = 'per_view'").select("seq", "context", F.round("value", 6).alias("value"))
