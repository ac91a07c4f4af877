"""Register frames and keyed state over the events feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registry as fn
from ..operators import registers as M
from ..operators import state as S
from .feeds import MAPPED, mapped, table
from .registry import query

#: Register frames: one register each, by event; the SQL works on the numbers themselves.
FRAMES = """frames AS (SELECT ts AS time, event_id AS seq, 'c' || (event_id % 2) AS connector, CAST(user_id % 4 + 1 AS INT) AS slave,
  CASE WHEN event_id % 11 = 0 THEN 3 ELSE 4 END AS function_code, CAST(22 + event_id % 3 AS INT) AS address,
  CASE WHEN event_id % 13 = 0 THEN 32767 WHEN event_id % 17 = 0 THEN 0 ELSE CAST((CAST(floor(value * 100000) AS BIGINT)) % 65536 AS INT) END AS word FROM events)"""


def register_numbers(spark, d):
    e = table(spark, d, "events")
    word = (
        F.when(F.col("event_id") % 13 == 0, 32767)
        .when(F.col("event_id") % 17 == 0, 0)
        .otherwise((F.floor(F.col("value") * 100000).cast("long") % 65536).cast("int"))
    )
    return e.select(
        F.col("ts").alias("time"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("c"), F.col("event_id") % 2).alias("connector"),
        (F.col("user_id") % 4 + 1).cast("int").alias("slave"),
        F.when(F.col("event_id") % 11 == 0, 3).otherwise(4).alias("function_code"),
        (22 + F.col("event_id") % 3).cast("int").alias("address"),
        word.alias("word"),
    )


def register_frames(spark, d):
    n = register_numbers(spark, d)
    value = M.encode(F.col("slave"), F.col("function_code"), F.col("address"), F.array("word"))
    return n.select("time", "seq", "connector", value.alias("value"))


@query("p05_registers", f"WITH {FRAMES} SELECT seq, slave, function_code, address, 1 AS n, address AS register, word FROM frames")
def p05(spark, d):
    return M.registers(M.decode_header(register_frames(spark, d))).select("seq", "slave", "function_code", "address", "n", "register", "word")


@query("p06_coils", f"WITH {FRAMES} SELECT seq, address + i AS coil, (word + i) % 3 = 0 AS state FROM frames, (VALUES (0), (1)) t(i)")
def p06(spark, d):
    n = register_numbers(spark, d)
    states = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: (F.col("word") + i) % 3 == 0)
    frames = n.select("seq", M.encode(F.col("slave"), F.lit(1), F.col("address"), M.coil_words(states)).alias("value"))
    return M.coils(M.decode_header(frames)).select("seq", "coil", "state")


@query("p19_frame_columns", f"WITH {FRAMES} SELECT seq, printf('%02X%04X%04X%04X%04X', slave, function_code, address, 1, word) AS frame FROM frames")
def p19(spark, d):
    f = M.decode_header(register_frames(spark, d))
    again = M.encode(F.col("slave"), F.col("function_code"), F.col("address"), F.col("words"))
    return f.select("seq", F.hex(again).alias("frame"))


@query("f05_sensor_fault", f"WITH {FRAMES} SELECT seq FROM frames WHERE word NOT IN (0, 32767, 32768)")
def f05(spark, d):
    return M.without_faults(M.decode_header(register_frames(spark, d))).select("seq")


DELTA_SQL = f"""WITH {FRAMES}, ok AS (SELECT * FROM frames WHERE word NOT IN (0, 32767, 32768)),
  w AS (SELECT *, lag(word) OVER k AS b, lag(time) OVER k AS t, min(seq) OVER (PARTITION BY connector, slave) = seq AS f
    FROM ok WINDOW k AS (PARTITION BY connector, slave, address ORDER BY time, seq)),
  s AS (SELECT *, word - coalesce(b, 0) AS step FROM w)"""


@query("w03_register_delta", f"""{DELTA_SQL} SELECT seq, address AS register, CASE WHEN b IS NULL AND f THEN word WHEN step < -50000 THEN step + 65535
  WHEN step > 50000 THEN step - 65535 ELSE step END AS delta FROM s""")
def w03(spark, d):
    rows = M.registers(M.without_faults(M.decode_header(register_frames(spark, d))))
    return M.deltas(rows).select("seq", "register", "delta")


@query("w04_time_delta", f"{DELTA_SQL} SELECT seq, date_diff('microsecond', t, time) // 1000 AS time_delta FROM s")
def w04(spark, d):
    rows = M.registers(M.without_faults(M.decode_header(register_frames(spark, d))))
    return M.deltas(rows).select("seq", "time_delta")


RULES = [(1, 4, 22, 1, "engine.a"), (1, 4, 23, 1, "engine.b"), (2, 4, 22, 2, "engine.c"), (3, 4, 24, 1, "engine.d"), (1, 3, 22, 1, "engine.e")]


@query(
    "j01_rule_containment",
    f"""WITH {FRAMES}, rules(slave, function_code, r_address, r_n, path) AS (VALUES {', '.join(map(str, RULES))})
    SELECT seq, path FROM frames f JOIN rules r ON f.slave = r.slave AND f.function_code = r.function_code
    AND r_address >= address AND r_address + r_n <= address + 1""",
)
def j01(spark, d):
    rules = spark.createDataFrame(RULES, "slave int, function_code int, r_address int, r_n int, path string")
    return M.contained_rules(M.decode_header(register_frames(spark, d)), rules).select("seq", "path")


@query("f14_rule_results", f"WITH {FRAMES} SELECT seq, CAST(word - 4000 AS DOUBLE) AS value FROM frames WHERE word > 4000")
def f14(spark, d):
    f = M.decode_header(register_frames(spark, d)).withColumn("word", M.at(F.col("address")))
    return M.rule_results(f, "CASE WHEN word > 4000 THEN word - 4000 END", "seq")


#: Frames of one to five registers, and of so many coils, whose words are made from the event and the place.
MANY = """n AS (SELECT event_id AS seq, CAST(user_id % 4 + 1 AS INT) AS slave, CAST(event_id % 5 + 1 AS INT) AS n, CAST(event_id * 13 % 500 AS INT) AS address FROM events),
  w AS (SELECT *, unnest(range(n)) AS i FROM n), x AS (SELECT *, CAST((seq * 31 + i * 7919) % 65536 AS INT) AS word FROM w)"""


def many_frames(spark, d):
    k, n = F.col("event_id"), (F.col("event_id") % 5 + 1).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: ((k * 31 + i * 7919) % 65536).cast("int"))
    value = M.encode((F.col("user_id") % 4 + 1).cast("int"), F.when(k % 2 == 0, F.lit(3)).otherwise(F.lit(4)), (k * 13 % 500).cast("int"), words)
    return table(spark, d, "events").select(k.alias("seq"), value.alias("value"))


@query("p05_many_registers", f"WITH {MANY} SELECT seq, slave, n, CAST(address + i AS INT) AS register, word FROM x")
def p05_many(spark, d):
    """Frames of several registers."""
    return M.registers(M.decode_header(many_frames(spark, d))).select("seq", "slave", "n", "register", "word")


@query(
    "f14_failing_results",
    f"""WITH {MANY} SELECT a.seq, CAST(a.word AS DOUBLE) / (b.word % 4) AS value FROM x a JOIN x b ON a.seq = b.seq AND a.i = 0 AND b.i = 1 WHERE b.word % 4 <> 0""",
)
def f14_failing(spark, d):
    """A rule over two registers, of which frames of one register have no second and some divide by zero."""
    return M.rule_results(M.decode_header(many_frames(spark, d)), "words[0] / (words[1] % 4)", "seq")


@query(
    "p15_write_frames",
    f"""WITH {FRAMES} SELECT seq, CASE WHEN seq % 5 = 0 THEN 'value out of range' WHEN seq % 7 = 0 THEN 'wrong number of values' END AS reason,
    CASE WHEN seq % 5 <> 0 AND seq % 7 <> 0 THEN printf('%02X%04X%04X%04X%04X', slave, function_code, address, 1, word) END AS frame FROM frames""",
)
def p15(spark, d):
    rows = register_numbers(spark, d).withColumn("n", F.lit(1))
    values = F.when(F.col("seq") % 5 == 0, F.array(F.lit(70000))).when(F.col("seq") % 7 == 0, F.array("word", "word")).otherwise(F.array("word"))
    return M.write_frames(rows, values).select("seq", "reason", F.hex("frame").alias("frame"))


LIMITED = f"""WITH RECURSIVE {MAPPED},
  m AS (SELECT *, row_number() OVER (PARTITION BY context, path, connector ORDER BY seq) AS n FROM mapped),
  scan AS (
    SELECT context, path, connector, n, seq, time AS last, true AS kept FROM m WHERE n = 1
    UNION ALL
    SELECT m.context, m.path, m.connector, m.n, m.seq,
           CASE WHEN m.time > s.last + INTERVAL 6 HOUR THEN m.time ELSE s.last END, m.time > s.last + INTERVAL 6 HOUR
    FROM scan s JOIN m ON m.context = s.context AND m.path = s.path AND m.connector = s.connector AND m.n = s.n + 1)"""


@query("f02_rate_limit", f"{LIMITED} SELECT seq, context, path FROM scan WHERE kept")
def f02(spark, d):
    return S.rate_limit(mapped(spark, d), 6 * 3600).select("seq", "context", "path")


@query(
    "f02_rate_limit_first_free",
    f"""WITH RECURSIVE {MAPPED}, f AS (SELECT *, seq = min(seq) OVER (PARTITION BY context, path) AS free FROM mapped),
    m AS (SELECT *, row_number() OVER (PARTITION BY context, path, connector ORDER BY seq) AS n FROM f WHERE NOT free),
    scan AS (SELECT context, path, connector, n, seq, time AS last, true AS kept FROM m WHERE n = 1
      UNION ALL SELECT m.context, m.path, m.connector, m.n, m.seq, CASE WHEN m.time > s.last + INTERVAL 6 HOUR THEN m.time ELSE s.last END, m.time > s.last + INTERVAL 6 HOUR
      FROM scan s JOIN m ON m.context = s.context AND m.path = s.path AND m.connector = s.connector AND m.n = s.n + 1)
    SELECT seq, context, path FROM scan WHERE kept UNION ALL SELECT seq, context, path FROM f WHERE free""",
)
def f02_free(spark, d):
    """The very first row of a path passes without being remembered."""
    return S.rate_limit(mapped(spark, d), 6 * 3600, record_first=False).select("seq", "context", "path")


VALUES = "v AS (SELECT * REPLACE (CAST(floor(value / 40) AS BIGINT) AS value) FROM mapped)"


def steps(spark, d):
    return mapped(spark, d).withColumn("value", F.floor(F.col("value") / 40).cast("long"))


@query(
    "f03_changes",
    f"""WITH {MAPPED}, {VALUES} SELECT seq, context, path, value FROM (SELECT *, lag(value) OVER w AS b, row_number() OVER w AS n FROM v
    WINDOW w AS (PARTITION BY context, path ORDER BY seq)) WHERE n = 1 OR value IS DISTINCT FROM b""",
)
def f03(spark, d):
    return S.changes(steps(spark, d)).select("seq", "context", "path", "value")


SHUFFLED = "s AS (SELECT * REPLACE ((seq * 7919) % 10007 AS seq) FROM v)"


#: Shuffled numbers repeat beyond 10,007 events; of equal ones the event's own number decides.
ARRIVAL = ["seq", "event"]


def disordered(spark, d):
    return steps(spark, d).withColumns({"event": F.col("seq"), "seq": (F.col("seq") * 7919) % 10007})


@query(
    "f04_late_rows",
    f"""WITH {MAPPED}, {VALUES}, {SHUFFLED} SELECT seq, context, path FROM (SELECT *, max(time) OVER (PARTITION BY context, path
    ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s) WHERE b IS NULL OR time >= b""",
)
def f04(spark, d):
    return S.without_late(disordered(spark, d), ARRIVAL).select("seq", "context", "path")


@query(
    "f03_f04_changes_without_late",
    f"""WITH RECURSIVE {MAPPED}, {VALUES}, {SHUFFLED},
    m AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY seq) AS n FROM s),
    scan AS (SELECT context, path, n, seq, time AS t, value AS x, true AS kept FROM m WHERE n = 1
      UNION ALL SELECT m.context, m.path, m.n, m.seq, CASE WHEN m.time >= c.t AND m.value <> c.x THEN m.time ELSE c.t END,
        CASE WHEN m.time >= c.t AND m.value <> c.x THEN m.value ELSE c.x END, m.time >= c.t AND m.value <> c.x
      FROM scan c JOIN m ON m.context = c.context AND m.path = c.path AND m.n = c.n + 1)
    SELECT seq, context, path FROM scan WHERE kept""",
)
def f0304(spark, d):
    return S.changes_without_late(disordered(spark, d), arrival=ARRIVAL).select("seq", "context", "path")


@query(
    "w05_moving_average",
    f"""WITH {MAPPED} SELECT seq, round(avg(value) OVER (PARTITION BY context, path ORDER BY time
    RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS average FROM mapped""",
)
def w05(spark, d):
    return S.moving_average(mapped(spark, d).select("seq", "context", "path", "time", "value"), "1 DAY").select("seq", F.round("average", 6).alias("average"))


@query(
    "w10_silence",
    f"""WITH {MAPPED} SELECT connector, time AS last_seen, n AS next_seen FROM (SELECT *, lead(time) OVER (PARTITION BY connector
    ORDER BY time, seq) AS n FROM mapped) WHERE n > time + INTERVAL 30 MINUTE""",
)
def w10(spark, d):
    return S.silences(mapped(spark, d), "30 MINUTES")


FIELDS = "CASE WHEN seq % 3 = 0 THEN value END AS latitude, CASE WHEN seq % 3 = 1 THEN value END AS longitude, CASE WHEN seq % 5 = 0 THEN value END AS altitude"


def positions(spark, d):
    m = mapped(spark, d)
    f = lambda c: F.when(c, F.col("value"))
    return m.select("seq", "context", "path", f(F.col("seq") % 3 == 0).alias("latitude"), f(F.col("seq") % 3 == 1).alias("longitude"), f(F.col("seq") % 5 == 0).alias("altitude"))


NAMES = ["latitude", "longitude", "altitude"]


@query(
    "a08_merge_running",
    f"""WITH {MAPPED}, p AS (SELECT seq, context, path, {FIELDS} FROM mapped)
    SELECT seq, context, path, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in NAMES)} FROM p
    WINDOW w AS (PARTITION BY context, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def a08(spark, d):
    return S.merged_fields(positions(spark, d), NAMES)


@query(
    "a08_merge_final",
    f"""WITH {MAPPED}, p AS (SELECT seq, context, path, {FIELDS} FROM mapped)
    SELECT context, path, {', '.join(f'arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in NAMES)} FROM p GROUP BY context, path""",
)
def a08_final(spark, d):
    return S.final_fields(positions(spark, d), NAMES)


#: Values of six shapes, of which the number and the text don't merge.
SHAPED = """p AS (SELECT seq, context, path, CASE seq * 7 % 11 WHEN 0 THEN 'number' WHEN 1 THEN 'spectrum' WHEN 2 THEN 'text' WHEN 3 THEN 'draft' WHEN 4 THEN 'draft' ELSE 'position' END AS shape, value FROM mapped),
  q AS (SELECT seq, context, path, shape, CASE WHEN shape IN ('number', 'text') OR shape = 'draft' AND seq % 2 = 0 THEN value END AS number, CASE WHEN shape = 'position' AND seq % 3 = 0 THEN value END AS latitude,
    CASE WHEN shape = 'position' AND seq % 3 = 1 THEN value END AS longitude, CASE WHEN shape = 'spectrum' THEN [value, seq::DOUBLE] WHEN shape = 'draft' AND seq % 3 > 0 THEN [value] ELSE [] END AS list FROM p)"""


@query(
    "a08_merge_shapes",
    f"""WITH RECURSIVE {MAPPED}, {SHAPED}, o AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY seq) AS n FROM q),
    s AS (SELECT * FROM o WHERE n = 1 UNION ALL
      SELECT o.seq, o.context, o.path, CASE WHEN stays THEN s.shape ELSE o.shape END, CASE WHEN stays THEN s.number WHEN joins THEN coalesce(o.number, s.number) ELSE o.number END,
        CASE WHEN stays THEN s.latitude WHEN joins THEN coalesce(o.latitude, s.latitude) ELSE o.latitude END, CASE WHEN stays THEN s.longitude WHEN joins THEN coalesce(o.longitude, s.longitude) ELSE o.longitude END,
        CASE WHEN stays OR joins AND len(o.list) = 0 THEN s.list ELSE o.list END, o.n
      FROM s JOIN o ON o.context = s.context AND o.path = s.path AND o.n = s.n + 1, LATERAL (SELECT s.shape = 'spectrum' AND o.shape NOT IN ('number', 'text') AS stays,
        s.shape = o.shape AND s.shape IN ('draft', 'position') AS joins))
    SELECT seq, context, path, shape, number, latitude, longitude, list_sum(list) AS total, len(list) AS n_list FROM s""",
)
def a08_shapes(spark, d):
    k, v = F.col("seq"), F.col("value")
    kinds = F.array(*map(F.lit, ["number", "spectrum", "text", "draft", "draft", *["position"] * 6]))
    m = mapped(spark, d).select("seq", "context", "path", "value", F.get(kinds, (k * 7 % 11).cast("int")).alias("shape"))
    s = F.col("shape")
    m = m.select(
        "seq", "context", "path", "shape",
        F.when(s.isin("number", "text") | ((s == "draft") & (k % 2 == 0)), v).alias("number"),
        F.when((s == "position") & (k % 3 == 0), v).alias("latitude"),
        F.when((s == "position") & (k % 3 == 1), v).alias("longitude"),
        F.when(s == "spectrum", F.array(v, k.cast("double"))).when((s == "draft") & (k % 3 > 0), F.array(v)).otherwise(F.array().cast("array<double>")).alias("list"),
    )
    out = S.merged_shapes(m, ["number", "latitude", "longitude"], ["list"])
    total = F.when(F.size("list") > 0, F.aggregate("list", F.lit(0.0), lambda a, x: a + x))
    return out.select("seq", "context", "path", "shape", "number", "latitude", "longitude", total.alias("total"), F.size("list").cast("long").alias("n_list"))


#: All eight shapes and two values that have none, with fields by shape; the rules of each shape stand in the SQL by name.
EIGHT = """k AS (SELECT seq, context, path, time, CASE WHEN seq * 7919 % 23 < 4 THEN 'position' WHEN seq * 7919 % 23 < 8 THEN 'vesselInfo' WHEN seq * 7919 % 23 < 11 THEN 'vesselType'
    WHEN seq * 7919 % 23 < 14 THEN 'length' WHEN seq * 7919 % 23 < 17 THEN 'notification' WHEN seq * 7919 % 23 < 20 THEN 'draft' WHEN seq * 7919 % 23 = 20 THEN 'spectrum' WHEN seq * 7919 % 23 = 21 THEN 'vector3d' ELSE 'text' END AS shape,
    seq % 3 AS part, floor(value / 30) AS v FROM mapped),
  g AS (SELECT seq, context, path, time, shape, CASE WHEN part <> 1 THEN v END AS a, CASE WHEN part <> 0 THEN v + 1 END AS b, CASE WHEN shape IN ('draft', 'spectrum') AND part <> 2 THEN [v] ELSE [] END AS l FROM k)"""
MERGED_SQL = """CASE WHEN s.shape = 'spectrum' AND g.shape IN ('position', 'vesselInfo', 'vesselType', 'length', 'notification', 'draft', 'spectrum') THEN 'stay'
    WHEN s.shape = g.shape AND g.shape IN ('position', 'vesselInfo', 'vesselType', 'length', 'notification', 'draft') THEN 'merge' ELSE 'replace' END"""


def eight_shapes(spark, d):
    k = F.col("seq")
    names = ["position"] * 4 + ["vesselInfo"] * 4 + ["vesselType"] * 3 + ["length"] * 3 + ["notification"] * 3 + ["draft"] * 3 + ["spectrum", "vector3d", "text"]
    shape = F.get(F.array(*map(F.lit, names)), (k * 7919 % 23).cast("int"))
    v, part = F.floor(F.col("value") / 30).cast("double"), k % 3
    m = mapped(spark, d).select("seq", "context", "path", "time", shape.alias("shape"), F.when(part != 1, v).alias("a"), F.when(part != 0, v + 1).alias("b"), v.alias("v"))
    return m.select(
        "seq", "context", "path", "time", "shape", "a", "b", F.when(F.col("shape").isin("draft", "spectrum") & (k % 3 != 2), F.array("v")).otherwise(F.array().cast("array<double>")).alias("l")
    )


@query(
    "a08_merge_all_shapes",
    f"""WITH RECURSIVE {MAPPED}, {EIGHT}, o AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY seq) AS n FROM g),
    s AS (SELECT * EXCLUDE (time) FROM o WHERE n = 1 UNION ALL
      SELECT g.seq, g.context, g.path, CASE rule WHEN 'stay' THEN s.shape ELSE g.shape END, CASE rule WHEN 'stay' THEN s.a WHEN 'merge' THEN coalesce(g.a, s.a) ELSE g.a END,
        CASE rule WHEN 'stay' THEN s.b WHEN 'merge' THEN coalesce(g.b, s.b) ELSE g.b END, CASE WHEN rule = 'stay' OR rule = 'merge' AND len(g.l) = 0 THEN s.l ELSE g.l END, g.n
      FROM s JOIN o g ON g.context = s.context AND g.path = s.path AND g.n = s.n + 1, LATERAL (SELECT {MERGED_SQL} AS rule))
    SELECT seq, context, path, shape, a, b, l[1] AS first FROM s""",
)
def a08_all(spark, d):
    out = S.merged_shapes(eight_shapes(spark, d).drop("time"), ["a", "b"], ["l"])
    return out.select("seq", "context", "path", "shape", "a", "b", F.get("l", F.lit(0)).alias("first"))


#: Rows in an order of arrival that isn't that of time, few contexts, and a scan over what is kept.
MERGED_CHANGES = f"""WITH RECURSIVE {MAPPED}, {EIGHT}, q AS (SELECT * REPLACE ((seq * 7919) % 10007 AS seq) FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY seq) AS n FROM q),
    s AS (SELECT seq, context, path, time, shape, a, b, l, n, true AS kept FROM o WHERE n = 1 UNION ALL
      SELECT g.seq, g.context, g.path, CASE WHEN drops THEN s.time ELSE g.time END, CASE WHEN drops OR rule = 'stay' THEN s.shape ELSE g.shape END,
        CASE WHEN drops OR rule = 'stay' THEN s.a WHEN rule = 'merge' THEN coalesce(g.a, s.a) ELSE g.a END, CASE WHEN drops OR rule = 'stay' THEN s.b WHEN rule = 'merge' THEN coalesce(g.b, s.b) ELSE g.b END,
        CASE WHEN drops OR rule = 'stay' OR rule = 'merge' AND len(g.l) = 0 THEN s.l ELSE g.l END, g.n, NOT drops
      FROM s JOIN o g ON g.context = s.context AND g.path = s.path AND g.n = s.n + 1, LATERAL (SELECT {MERGED_SQL} AS rule),
        LATERAL (SELECT g.time < s.time OR (g.shape = s.shape AND g.a IS NOT DISTINCT FROM s.a AND g.b IS NOT DISTINCT FROM s.b AND g.l = s.l) AS drops))
    SELECT seq, context, path, shape, a, b, l[1] AS first FROM s WHERE kept"""


def arriving_shapes(spark, d):
    return eight_shapes(spark, d).withColumns({"event": F.col("seq"), "seq": (F.col("seq") * 7919) % 10007})


@query("f03_merged_changes", MERGED_CHANGES)
def f03_merged(spark, d):
    """Changes and late rows over what values of all shapes merge to."""
    out = S.merged_changes(arriving_shapes(spark, d), ["a", "b"], ["l"], arrival=ARRIVAL)
    return out.select("seq", "context", "path", "shape", "a", "b", F.get("l", F.lit(0)).alias("first"))


@query(
    "j03_last_known_combine",
    f"""WITH {MAPPED}, k AS (SELECT *, last_value(CASE WHEN path = 'click' THEN value END IGNORE NULLS) OVER w AS a,
      last_value(CASE WHEN path = 'view' THEN value END IGNORE NULLS) OVER w AS b, max(time) OVER w AS t FROM mapped WHERE path IN ('click', 'view')
      WINDOW w AS (PARTITION BY context ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT seq, context, path, time, value FROM mapped WHERE path <> 'sum'
    UNION ALL SELECT seq, context, 'sum', t, a + b FROM k WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def j03(spark, d):
    m = mapped(spark, d)
    return S.combine(m, ["click", "view"], F.col("click") + F.col("view"), "sum", overwrite=True).select("seq", "context", "path", "time", "value")


@query(
    "u01_math_functions",
    """SELECT l_orderkey, l_linenumber, (l_quantity * 1000 - 4000) / 16000 AS ratio, l_extendedprice / (l_quantity * 9.8) AS height,
    abs(2 * pi() * l_quantity * l_tax) AS power, abs(l_quantity) * CASE WHEN l_discount - 0.05 < 0 THEN -1 ELSE 1 END AS signed FROM lineitem""",
)
def u01_math(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        fn.current_to_ratio(F.col("l_quantity") * 1000).alias("ratio"),
        fn.pressure_to_height(F.col("l_extendedprice"), F.col("l_quantity")).alias("height"),
        fn.power_w(F.col("l_quantity"), F.col("l_tax")).alias("power"),
        fn.copy_sign(F.col("l_quantity"), F.col("l_discount") - 0.05).alias("signed"),
    )


@query(
    "u01_bit_functions",
    """WITH b AS (SELECT o_orderkey, CAST(o_orderkey * 7919 % 65536 AS BIGINT) AS hi, CAST(o_custkey * 104729 % 65536 AS BIGINT) AS lo FROM orders)
    SELECT o_orderkey, hi * 65536 + lo AS u32, hi * 65536 + lo - CASE WHEN hi >= 32768 THEN 4294967296 ELSE 0 END AS i32,
    hi - CASE WHEN hi >= 32768 THEN 65536 ELSE 0 END AS i16, hi & lo AS both_bits, hi | lo AS any_bits, xor(hi, lo) AS odd_bits,
    65535 - hi AS other_bits, (hi & 5) = 5 AS has_bits FROM b""",
)
def u01_bits(spark, d):
    hi, lo = F.col("hi"), F.col("lo")
    b = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 65536).alias("hi"), (F.col("o_custkey") * 104729 % 65536).alias("lo"))
    return b.select(
        "o_orderkey",
        fn.to_uint32(hi, lo).alias("u32"),
        fn.to_int32(hi, lo).alias("i32"),
        fn.to_int(hi).alias("i16"),
        hi.bitwiseAND(lo).alias("both_bits"),
        hi.bitwiseOR(lo).alias("any_bits"),
        hi.bitwiseXOR(lo).alias("odd_bits"),
        fn.bit_not(hi).alias("other_bits"),
        fn.contains_bits(hi, F.lit(5)).alias("has_bits"),
    )


@query(
    "u01_rule_functions",
    """WITH b AS (SELECT event_id, CAST(event_id * 7919 % 65536 AS BIGINT) AS x, value, event_type FROM events)
    SELECT event_id, x // 256 * 256 + x % 256 AS word, (x >> 3) % 2 = 1 AS fourth, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * CAST(event_id % 64 + 128 AS DOUBLE) / 128 AS single,
    (value + event_id) / 2 AS average, value > 50 AS state, event_type AS message,
    CASE WHEN value < 10 THEN 0 WHEN value < 30 THEN 100 + (value - 10) / 20 * 100 WHEN value < 70 THEN 200 + (value - 30) / 40 * 500 ELSE 700 END AS volume FROM b""",
)
def u01_rules(spark, d):
    """The functions of rules as their SQL text, over columns."""
    x = "CAST(event_id * 7919 % 65536 AS INT)"
    e = table(spark, d, "events")
    note = F.get(fn.call("notify", "value > 50", "event_type"), F.lit(0))
    return e.select(
        "event_id",
        fn.call("toUInt", f"{x} div 256", f"{x} % 256").cast("long").alias("word"),
        fn.call("isBitSet", x, "3").alias("fourth"),
        fn.call("toFloat", "IF(event_id % 3 = 0, 32768, 0) + 16256 + event_id % 64", "0").alias("single"),
        fn.call("movingAverage", "array(value, CAST(event_id AS DOUBLE))").alias("average"),
        note["state"].alias("state"),
        note["message"].alias("message"),
        fn.call("heightToVolume", "value - 1D", "1D", "array(10D, 30D, 70D)", "array(100D, 200D, 700D)").alias("volume"),
    )


@query("u01_string_functions", "SELECT event_id, translate(CAST(event_id AS VARCHAR) || '.5,1', '.,', ',.') AS swapped, replace(event_type || '.x.y', '.', '_') AS flat, md5(event_type) AS digest FROM events")
def u01_strings(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.col("event_id").cast("string"), F.lit(".5,1"))
    return e.select("event_id", fn.swap_marks(text).alias("swapped"), F.translate(F.concat("event_type", F.lit(".x.y")), ".", "_").alias("flat"), F.md5("event_type").alias("digest"))


@query("u01_time_functions", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, time_bucket(INTERVAL 5 MINUTE, ts) AS start FROM events")
def u01_time(spark, d):
    from ..operators.rollup import period_start

    text = fn.format_time(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", fn.format_time(fn.parse_time(text)).alias("text"), period_start("ts").alias("start"))


@query(
    "u01_checksum",
    """SELECT event_id, printf('%02X', list_reduce(list_transform(string_split(event_type || event_id, ''), lambda c: ord(c)), lambda a, b: xor(a, b))) AS sum FROM events""",
)
def u01_checksum(spark, d):
    return table(spark, d, "events").select("event_id", fn.checksum(F.concat("event_type", F.col("event_id").cast("string"))).alias("sum"))
