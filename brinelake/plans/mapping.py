"""Flattening, shapes, rules, filters and exports over the events feed."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import export as X
from ..operators import flatten as D
from ..operators import rules as R
from ..operators import shapes as V
from ..sources.tables import fan_in
from .feeds import MAPPED, mapped, table
from .registry import query

WHOLE = "v AS (SELECT * REPLACE (CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value) FROM mapped)"


def texts(spark, d):
    """Mapped rows whose values are whole numbers as JSON text."""
    return mapped(spark, d).withColumn("value", F.floor("value").cast("long").cast("string"))


def deltas(spark, d):
    """Deltas of up to four values: rows with the same seq div 4, context and origin; rows of one uuid are one update."""
    rows = texts(spark, d).withColumn("msg", F.expr("seq div 4")).withColumn("update_no", F.expr("cast(seq % 4 div 2 as int)")).withColumn("value_no", F.expr("cast(seq % 2 as int)"))
    rows = rows.withColumn("uuid", F.concat(F.lit("u"), "msg")).withColumn("connector", F.lit("c0")).withColumn("time", F.date_trunc("month", "time").cast("timestamp_ntz"))
    return rows


@query("p11_flatten", f"WITH {MAPPED}, {WHOLE} SELECT seq, context, origin, path, value, uuid, connector FROM v")
def p11(spark, d):
    return D.flatten(D.rebuild(texts(spark, d), "seq"), "seq").select("seq", "context", "origin", "path", "value", "uuid", "connector")


@query(
    "p12_rebuild_grouped",
    f"""WITH {MAPPED}, {WHOLE}, r AS (SELECT seq // 4 AS msg, context, origin, path, value, CAST(seq % 4 // 2 AS INT) AS u, CAST(seq % 2 AS INT) AS n, date_trunc('month', time) AS t FROM v)
    SELECT msg, context, origin, CAST(dense_rank() OVER (PARTITION BY msg, context, origin ORDER BY u, t) - 1 AS INT) AS update_no,
      CAST(row_number() OVER (PARTITION BY msg, context, origin, u, t ORDER BY n) - 1 AS INT) AS value_no, path, value FROM r""",
)
def p12(spark, d):
    grouped = D.rebuild_grouped(deltas(spark, d), ["msg"])
    return D.flatten(grouped, "msg").select("msg", "context", "origin", "update_no", "value_no", "path", "value")


LISTED = f"""{WHOLE}, m AS (SELECT seq // 8 AS msg, context, event_path AS path, CAST(seq % 8 AS INT) AS n,
    CASE WHEN event_path = 'click' THEN '[' || value || ']' ELSE value END AS value FROM (SELECT *, path AS event_path FROM v))"""


@query(
    "p13_same_path_merge",
    f"""WITH {MAPPED}, {LISTED} SELECT msg, context, path, max(n) AS value_no, CASE WHEN path = 'click'
      THEN '[' || string_agg(replace(replace(value, '[', ''), ']', ''), ',' ORDER BY n) || ']' ELSE arg_max(value, n) END AS value
    FROM m GROUP BY msg, context, path""",
)
def p13(spark, d):
    rows = texts(spark, d).select(
        F.expr("seq div 8").alias("msg"), "context", "path", F.expr("cast(seq % 8 as int)").alias("value_no"),
        F.when(F.col("path") == "click", F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")).alias("value"),
    )
    return D.merge_same_path(rows, ["msg", "context"])


MIXED = """x AS (SELECT seq // 16 AS msg, context, CAST(seq % 16 AS INT) AS n, CASE WHEN seq * 7919 % 10 < 2 THEN 'number' WHEN seq * 7919 % 10 < 7 THEN 'note' WHEN seq * 7919 % 10 < 9 THEN 'float' ELSE 'none' END AS kind, seq FROM mapped),
  y AS (SELECT *, CASE kind WHEN 'number' THEN CAST(seq AS VARCHAR) WHEN 'note' THEN '{"message":"m' || seq || '"}' WHEN 'float' THEN seq || '.5,' || seq || '.25' ELSE '' END AS item FROM x)"""


@query(
    "p13_ordered_fold",
    f"""WITH RECURSIVE {MAPPED}, {MIXED}, o AS (SELECT *, CASE kind WHEN 'none' THEN 'note' ELSE kind END AS t, row_number() OVER (PARTITION BY msg, context ORDER BY n) AS i FROM y),
    f AS (SELECT msg, context, n, i, t, item AS acc FROM o WHERE i = 1
      UNION ALL SELECT o.msg, o.context, o.n, o.i, o.t, CASE WHEN o.t = f.t AND o.t <> 'number' THEN CASE WHEN f.acc = '' THEN o.item WHEN o.item = '' THEN f.acc ELSE f.acc || ',' || o.item END ELSE o.item END
      FROM f JOIN o ON o.msg = f.msg AND o.context = f.context AND o.i = f.i + 1)
    SELECT DISTINCT ON (msg, context) msg, context, n AS value_no, CASE t WHEN 'number' THEN acc ELSE '[' || acc || ']' END AS value FROM f ORDER BY msg, context, i DESC""",
)
def p13_fold(spark, d):
    """Scalars, lists of two element types and empty lists on one path, in turns."""
    k = F.col("seq")
    roll, text = k * 7919 % 10, k.cast("string")
    value = (
        F.when(roll < 2, text)
        .when(roll < 7, F.concat(F.lit('[{"message":"m'), text, F.lit('"}]')))
        .when(roll < 9, F.concat(F.lit("["), text, F.lit(".5,"), text, F.lit(".25]")))
        .otherwise("[]")
    )
    rows = mapped(spark, d).select(F.expr("seq div 16").alias("msg"), "context", F.lit("p").alias("path"), (k % 16).cast("int").alias("value_no"), value.alias("value"))
    return D.merge_same_path(rows, ["msg", "context"]).drop("path")


@query("f09_empty_updates", f"WITH {MAPPED} SELECT seq FROM mapped WHERE seq % 3 <> 0")
def f09(spark, d):
    m = D.rebuild(texts(spark, d), "seq")
    return D.with_updates(m.withColumn("updates", F.when(F.col("seq") % 3 == 0, F.slice("updates", 1, 0)).otherwise(F.col("updates")))).select("seq")


@query("f10_overwrite_removal", f"WITH {MAPPED} SELECT seq, path FROM mapped m WHERE NOT EXISTS (SELECT 1 FROM mapped o WHERE o.seq = m.seq AND o.value > 50 AND o.path = 'click' AND m.path = 'click')")
def f10(spark, d):
    m = mapped(spark, d).select("seq", "path", "value")
    return D.without_overwritten(m, m.where("value > 50 and path = 'click'"), "seq").select("seq", "path")


@query(
    "x04_set_equality",
    f"""WITH {MAPPED} SELECT 'reordered' AS change, true AS equal UNION ALL SELECT 'a value', count(*) FILTER (WHERE seq % 97 = 3) = 0 FROM mapped
    UNION ALL SELECT 'repeated rows', count(*) FILTER (WHERE seq % 89 = 5) = 0 FROM mapped""",
)
def x04(spark, d):
    m = texts(spark, d)
    changed = m.withColumn("value", F.when(F.col("seq") % 97 == 3, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")))
    plain = m.withColumn("value", F.col("value").cast("string"))
    cases = {"reordered": D.same_values(m, D.flatten(D.rebuild(m.orderBy(F.desc("seq"))))), "a value": D.same_values(plain, changed), "repeated rows": D.same_values(m, m.unionByName(m.where("seq % 89 = 5")))}
    return functools.reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("change"), "equal") for name, df in cases.items()])


@query("x01_union_all", f"WITH {MAPPED} SELECT seq, path FROM mapped UNION ALL SELECT seq, path FROM mapped WHERE origin = 'v1'")
def x01(spark, d):
    m = mapped(spark, d).select("seq", "path", "origin")
    return fan_in(m, m.where("origin = 'v1'")).select("seq", "path")


@query("x02_union_distinct", f"WITH {MAPPED} SELECT context, path FROM mapped UNION SELECT origin, path FROM mapped")
def x02(spark, d):
    m = mapped(spark, d)
    return m.select("context", "path").union(m.select("origin", "path")).distinct()


OBJECT = """CASE seq % 7 WHEN 0 THEN '{"latitude":1.5,"longitude":2}' WHEN 1 THEN '{"mmsi":"5"}' WHEN 2 THEN '{"overall":3.5}' WHEN 3 THEN '{"state":true,"message":"m"}'
  WHEN 4 THEN '{}' WHEN 5 THEN '{"x":1,"y":2,"z":3}' ELSE '12' END"""


@query(
    "p14_shapes",
    f"""WITH {MAPPED} SELECT seq, CASE seq % 7 WHEN 0 THEN 'position' WHEN 1 THEN 'vesselInfo' WHEN 2 THEN 'length' WHEN 3 THEN 'notification' WHEN 4 THEN 'position'
    WHEN 5 THEN 'vector3d' ELSE 'integer' END AS shape FROM mapped""",
)
def p14(spark, d):
    return mapped(spark, d).select("seq", V.shape_of(F.expr(OBJECT)).alias("shape"))


INFO = """CASE WHEN seq % 3 = 0 THEN '{"mmsi":"' || seq || '"}' WHEN seq % 3 = 1 THEN '{"name":"n' || seq || '"}' ELSE CAST(seq AS STRING) END"""
INFO_ROWS = f"i AS (SELECT seq, CASE WHEN seq % 3 < 2 THEN '' ELSE path END AS path, {INFO.replace('STRING', 'VARCHAR')} AS value FROM mapped)"


def info(spark, d):
    return mapped(spark, d).select("seq", F.expr("CASE WHEN seq % 3 < 2 THEN '' ELSE path END").alias("path"), F.expr(INFO).alias("value"))


@query("p16_storage_path", f"WITH {MAPPED}, {INFO_ROWS} SELECT seq, CASE WHEN path = '' THEN CASE WHEN seq % 3 = 1 THEN 'name' ELSE 'mmsi' END ELSE path END AS path FROM i")
def p16(spark, d):
    return info(spark, d).select("seq", V.storage_path(F.col("path"), F.col("value")).alias("path"))


@query("p17_json_scalar", f"""WITH {MAPPED} SELECT seq, to_json(path || '"' || context)::VARCHAR AS value FROM mapped""")
def p17(spark, d):
    return mapped(spark, d).select("seq", V.json_scalar(F.concat("path", F.lit('"'), "context")).alias("value"))


@query("p20_resend_stamp", f"WITH {MAPPED} SELECT seq, 'r' || uuid AS transfer_uuid FROM mapped WHERE seq % 10 = 0")
def p20(spark, d):
    return mapped(spark, d).where("seq % 10 = 0").withColumn("transfer_uuid", F.concat(F.lit("r"), "uuid")).select("seq", "transfer_uuid")


PARTS = """p AS (SELECT seq // 3 AS msg, context, CASE seq % 4 WHEN 0 THEN 'position.altitude' WHEN 1 THEN 'position.latitude' WHEN 2 THEN 'position.longitude'
  ELSE 'other' END AS path, CAST(floor(value) AS BIGINT) || '.5' AS value FROM mapped)"""


def parts(spark, d):
    path = F.expr("CASE seq % 4 WHEN 0 THEN 'position.altitude' WHEN 1 THEN 'position.latitude' WHEN 2 THEN 'position.longitude' ELSE 'other' END")
    return mapped(spark, d).select(F.expr("seq div 3").alias("msg"), "context", path.alias("path"), F.concat(F.floor("value").cast("long"), F.lit(".5")).alias("value"))


FIELDS = ["altitude", "latitude", "longitude"]


@query(
    "a06_pivot_object",
    f"""WITH {MAPPED}, {PARTS}, g AS (SELECT msg, context, {', '.join(f"max(CAST(value AS DOUBLE)) FILTER (WHERE path = 'position.{f}') AS {f}" for f in FIELDS)}
      FROM p WHERE path <> 'other' GROUP BY msg, context)
    SELECT msg, context, path, value FROM p WHERE path = 'other' UNION ALL
    SELECT msg, context, 'position', '{{' || array_to_string(list_filter([{', '.join(f"""'"{f}":' || {f}""" for f in FIELDS)}], lambda x: x IS NOT NULL), ',') || '}}' FROM g""",
)
def a06(spark, d):
    return V.pivot_object(parts(spark, d), ["msg", "context"], "position", FIELDS)


@query(
    "p21_unpivot_object",
    f"""WITH {MAPPED}, {PARTS} SELECT msg, context, path, value FROM p WHERE path = 'other' UNION ALL
    SELECT msg, context, path, CAST(max(CAST(value AS DOUBLE)) AS VARCHAR) FROM p WHERE path <> 'other' GROUP BY msg, context, path""",
)
def p21(spark, d):
    by = ["msg", "context"]
    return V.unpivot_object(V.pivot_object(parts(spark, d), by, "position", FIELDS), by, "position", FIELDS)


@query("p22_log_messages", f"WITH {MAPPED} SELECT seq, date_trunc('second', time) AS start, seq % 9 AS local_count, CASE WHEN seq % 2 = 0 THEN seq % 7 END AS remote_count FROM mapped")
def p22(spark, d):
    m = mapped(spark, d).select("seq", F.date_trunc("second", "time").cast("timestamp_ntz").alias("start"), (F.col("seq") % 9).alias("local_count"), F.expr("CASE WHEN seq % 2 = 0 THEN seq % 7 END").alias("remote_count"))
    return V.unpack_message(V.pack_message(m, "seq"), "seq")


@query("p23_requote", f"""WITH {MAPPED} SELECT seq, path, CASE WHEN path IN ('click', 'view') THEN '"' || uuid || '"' ELSE uuid END AS quoted, uuid AS value FROM mapped""")
def p23(spark, d):
    m = mapped(spark, d).select("seq", "path", F.col("uuid").alias("value"))
    quoted = V.quote_paths(m, ["click", "view"])
    return V.unquote_paths(quoted.withColumn("quoted", F.col("value")), ["click", "view"])


@query("p24_vessel_info", f"WITH {MAPPED}, {INFO_ROWS} SELECT seq, path, value FROM i")
def p24(spark, d):
    return V.wrap_info(V.unwrap_info(info(spark, d)))


RULES = [R.Rule("double", "value * 2 + shift", constants={"shift": 10}), R.Rule("high", "CASE WHEN value > 50 THEN value END"), R.Rule("label", "concat(path, '/', origin)")]


@query(
    "p01_rule_projection",
    f"""WITH {MAPPED}, v AS (SELECT seq, path AS p, origin, CAST(floor(value) AS BIGINT) AS x FROM mapped)
    SELECT seq, 'double' AS path, CAST(x * 2 + 10 AS VARCHAR) AS value FROM v UNION ALL SELECT seq, 'high', CAST(x AS VARCHAR) FROM v WHERE x > 50
    UNION ALL SELECT seq, 'label', p || '/' || origin FROM v""",
)
def p01(spark, d):
    m = mapped(spark, d).withColumn("value", F.floor("value").cast("long"))
    return R.project(m, RULES, "seq")


@query("p02_json_mapping", "SELECT event_id, 'props.k' AS path, regexp_extract(props, '([0-9]+)', 1) AS value FROM events WHERE event_id % 5 <> 0")
def p02(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("value"))
    return R.project(R.json_payload(e), [R.Rule("props.k", "try_variant_get(json, '$.k', 'bigint')"), R.Rule("props.none", "try_variant_get(json, '$.none', 'bigint')")], "event_id")


@query(
    "p03_time_override",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY WHEN event_id % 3 = 1 THEN ts ELSE ts END AS time FROM events",
)
def p03(spark, d):
    e = table(spark, d, "events")
    old = F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).when(F.col("event_id") % 3 == 1, F.col("ts") - F.expr("INTERVAL 400 DAYS"))
    text = F.coalesce(F.date_format(old, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("no time"))
    return e.select("event_id", R.time_override(F.col("ts"), [text]).alias("time"))


@query(
    "p04_csv_mapping",
    """SELECT event_id, CAST(event_id % 100 AS DOUBLE) + 0.5 AS first, 0.0::DOUBLE AS second, CAST(event_id AS BIGINT) AS third FROM events WHERE event_id % 4 <> 0""",
)
def p04(spark, d):
    k = F.col("event_id")
    line = F.concat(F.when(k % 4 == 0, "OTHER;").otherwise("TANK:CT-1;"), (k % 100).cast("string"), F.lit(",5;none;"), k.cast("string"))
    e = table(spark, d, "events").select("event_id", line.alias("value"))
    out = R.csv_fields(e, "value", "TANK:CT-1;")
    return out.select("event_id", F.get("floats", F.lit(0)).alias("first"), F.get("floats", F.lit(1)).alias("second"), F.get("ints", F.lit(2)).alias("third"))


@query("f08_prefix", "SELECT event_id FROM events WHERE event_type LIKE 'c%'")
def f08(spark, d):
    return R.csv_fields(table(spark, d, "events"), "event_type", "c").select("event_id")


@query("p07_binary_mapping", "SELECT event_id, event_id % 256 AS low, event_id // 256 % 256 AS high FROM events")
def p07(spark, d):
    value = F.unhex(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))
    return table(spark, d, "events").withColumn("v", value).select("event_id", R.byte_at(F.col("v"), 1).cast("long").alias("low"), R.byte_at(F.col("v"), 0).cast("long").alias("high"))


@query("p18_quarantine", f"WITH {MAPPED} SELECT seq, CASE WHEN seq % 10 = 0 THEN 'connector is missing' END AS reason FROM mapped")
def p18(spark, d):
    from ..functions.registry import invalid

    m = mapped(spark, d).withColumn("connector", F.when(F.col("seq") % 10 != 0, F.col("connector")))
    good, bad = R.quarantine(m, invalid(m, ["time", "connector", "uuid"]))
    return good.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("seq", "reason"))


FILTER = [R.Rule("click", "IF(seq % 20 = 0, NULL, value > 50)"), R.Rule("view", "connector = 'c1'")]


@query(
    "f01_expression_filter",
    f"""WITH {MAPPED}, b AS (SELECT DISTINCT seq // 4 AS msg FROM mapped WHERE path = 'click' AND seq % 20 = 0)
    SELECT seq, path FROM mapped WHERE seq // 4 NOT IN (SELECT msg FROM b)
      AND NOT (path = 'click' AND value > 50) AND NOT (path = 'view' AND connector = 'c1')""",
)
def f01(spark, d):
    return R.drop_where(mapped(spark, d).withColumn("msg", F.expr("seq div 4")), FILTER, "msg").select("seq", "path")


@query(
    "j10_dispatch",
    f"WITH {MAPPED}, r(rule_id, path) AS (VALUES (1, 'click'), (1, 'view'), (2, 'click')) SELECT seq, path, rule_id FROM mapped JOIN r USING (path)",
)
def j10(spark, d):
    rules = spark.createDataFrame([(1, ["click", "view"]), (2, ["click"])], "rule_id int, source_paths array<string>")
    return R.dispatch(mapped(spark, d).select("seq", "path"), rules)


@query(
    "k05_envelopes",
    f"""WITH {MAPPED}, n AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS n, '{{"seq":' || seq || ',"path":"' || path || '"}}' AS delta FROM mapped)
    SELECT n // 101 AS batch, '[' || string_agg(delta, ',' ORDER BY n) || ']' AS payload FROM n GROUP BY ALL""",
)
def k05(spark, d):
    return X.batches(mapped(spark, d), F.to_json(F.struct("seq", "path")), 100)


@query("k06_topics", f"""WITH {MAPPED}, {WHOLE} SELECT seq, 'live/' || replace(context, '.', '/') || '/' || replace(path, '.', '/') AS topic, '{{"value":"' || value || '"}}' AS payload FROM v""")
def k06(spark, d):
    return X.topics(texts(spark, d), "live")


@query("k09_feed", f"""WITH {MAPPED} SELECT '{{"seq":' || seq || ',"path":"' || path || '"}}' AS value FROM mapped""")
def k09(spark, d):
    return X.feed(mapped(spark, d).select("seq", "path"))


@query("w09_line_counter", f"WITH {MAPPED} SELECT seq, (row_number() OVER (ORDER BY seq) - 1) % 1000 AS n FROM mapped")
def w09(spark, d):
    return X.numbered(mapped(spark, d).select("seq"), ["seq"]).select("seq", (F.col("n") % 1000).alias("n"))


@query("s10_fan_in", f"WITH {MAPPED} SELECT connector, count(*) AS n FROM mapped GROUP BY connector")
def s10(spark, d):
    m = mapped(spark, d)
    return fan_in(*[m.where(F.col("connector") == f"c{i}") for i in range(3)]).groupBy("connector").agg(F.count("*").alias("n"))


#: A talker of each group by the standard's own table, as SQL; ZZ and QQ are unknown.
TALKER_SQL = """talkers(talker, target) AS (VALUES
  ('AG', 'NAVD'), ('AI', 'TGTD'), ('AP', 'NAVD'), ('BI', 'MISC'), ('BN', 'VDRD'), ('CD', 'RCOM'), ('CR', 'RCOM'), ('CS', 'RCOM'), ('CT', 'RCOM'), ('CV', 'RCOM'), ('CX', 'RCOM'),
  ('DF', 'NAVD'), ('DU', 'MISC'), ('EC', 'NAVD'), ('EI', 'NAVD'), ('EP', 'RCOM'), ('ER', 'MISC'), ('FD', 'VDRD'), ('FE', 'VDRD'), ('FR', 'VDRD'), ('FS', 'VDRD'), ('GA', 'NAVD'),
  ('GL', 'NAVD'), ('GN', 'NAVD'), ('GP', 'NAVD'), ('HC', 'NAVD'), ('HD', 'VDRD'), ('HE', 'SATD'), ('HF', 'NAVD'), ('HN', 'SATD'), ('HS', 'VDRD'), ('II', 'MISC'), ('IN', 'NAVD'),
  ('LC', 'NAVD'), ('NL', 'MISC'), ('RA', 'TGTD'), ('RC', 'MISC'), ('SD', 'NAVD'), ('SG', 'MISC'), ('SI', 'MISC'), ('SS', 'MISC'), ('TI', 'SATD'), ('U0', 'MISC'), ('U1', 'MISC'),
  ('U2', 'MISC'), ('U3', 'MISC'), ('U4', 'MISC'), ('U5', 'MISC'), ('U6', 'MISC'), ('U7', 'MISC'), ('U8', 'MISC'), ('U9', 'MISC'), ('UP', 'MISC'), ('VD', 'NAVD'), ('VM', 'NAVD'),
  ('VR', 'MISC'), ('VW', 'NAVD'), ('WD', 'VDRD'), ('WI', 'NAVD'), ('WL', 'VDRD'), ('YX', 'MISC'), ('ZA', 'TIME'), ('ZC', 'TIME'), ('ZQ', 'TIME'), ('ZV', 'TIME'))"""


@query(
    "j14_all_talkers",
    f"""WITH {TALKER_SQL}, n AS (SELECT talker, target, row_number() OVER (ORDER BY talker) - 1 AS n FROM talkers)
    SELECT event_id AS seq, talker, '239.1.0.' || CASE target WHEN 'MISC' THEN 1 WHEN 'TGTD' THEN 2 WHEN 'SATD' THEN 3 WHEN 'NAVD' THEN 4 WHEN 'VDRD' THEN 5 WHEN 'RCOM' THEN 6 ELSE 7 END AS address
    FROM events JOIN n ON event_id % 67 = n""",
)
def j14_all(spark, d):
    """Every talker of the standard, and two that it doesn't know, in the order of their letters."""
    groups = ("MISC", "TGTD", "SATD", "NAVD", "VDRD", "RCOM", "TIME")
    talkers = X.talker_table(spark, {g: (f"239.1.0.{k + 1}", 61001 + k) for k, g in enumerate(groups)})
    names = [*sorted(X.TALKERS), "ZZ", "QQ"]
    talker = F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    raw = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), F.lit("nmea0183").alias("type"), F.concat(F.lit("$"), talker, F.lit("ALR,x*00")).alias("value"))
    return X.line_frames(raw, talkers, seconds=False, count=False).select("seq", F.substring(F.substring_index("frame", "$", -1), 1, 2).alias("talker"), "address")


@query(
    "j14_talker_routing",
    """SELECT event_id AS seq, '239.0.0.2' AS address, CAST(60002 AS INT) AS port FROM events WHERE event_type = 'click'""",
)
def j14(spark, d):
    talkers = X.talker_table(spark, {"TGTD": ("239.0.0.2", 60002)})
    talker = F.when(F.col("event_type") == "click", "AI").otherwise("ZZ")
    raw = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), F.lit("nmea0183").alias("type"), F.concat(F.lit("$"), talker, F.lit("ALR,x*00")).alias("value"))
    return X.line_frames(raw, talkers, source="AB0001").select("seq", "address", "port")


@query(
    "k07_line_frames",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events),
    t AS (SELECT event_id, 's:AB0001,n:' || (n % 1000) AS tag FROM n)
    SELECT event_id AS seq, 'UdPbC' || chr(0) || chr(92) || tag || '*' || printf('%02X', list_reduce(list_transform(string_split(tag, ''), lambda c: ord(c)), lambda a, b: xor(a, b)))
      || chr(92) || '$GPGLL,' || event_id || chr(13) || chr(10) AS frame FROM t""",
)
def k07(spark, d):
    talkers = X.talker_table(spark, {g: ("239.0.0.1", 60000) for g in set(X.TALKERS.values())})
    raw = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("time"), F.lit("nmea0183").alias("type"), F.concat(F.lit("$GPGLL,"), F.col("event_id").cast("string")).alias("value"))
    return X.line_frames(raw, talkers, source="AB0001", seconds=False).select("seq", "frame")
