"""CAN, packed frames, calibration, sentences, spectra and voyages over the driver tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import nmea as N
from ..operators import signals as G
from ..operators import spectrum as P
from ..operators import voyages as Y
from .feeds import MAPPED, mapped, table
from .registry import query

#: Calibration of two tanks, made up here by a rule: heights and volumes of 21 steps, the second tank having twice the volume.
TANKS = [("t1" if k else "t", i, 1.23 + 0.0715 * i, (k + 1) * (4.0 + 2.0 * i)) for k in range(2) for i in range(21)]


def tank(spark):
    return spark.createDataFrame(TANKS, "tank string, n int, height double, volume double")


TANK_SQL = "tank(tank, n, height, volume) AS (VALUES " + ", ".join(f"('{t}', {i}, {h!r}::DOUBLE, {v!r}::DOUBLE)" for t, i, h, v in TANKS) + ")"


@query(
    "j13_calibration",
    f"""WITH {TANK_SQL}, steps AS (SELECT tank, height AS lo, lead(height) OVER w AS hi, volume AS v0, lead(volume) OVER w AS v1 FROM tank WINDOW w AS (PARTITION BY tank ORDER BY height)),
    r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 't1' ELSE 't' END AS tank, l_quantity / 50 * 1.5 + 1.2 AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN lo IS NULL THEN 0 WHEN hi IS NULL THEN v0 ELSE v0 + (h - lo) * (v1 - v0) / (hi - lo) END, 9) AS volume
    FROM r LEFT JOIN steps ON r.tank = steps.tank AND h >= lo AND (hi IS NULL OR h < hi)""",
)
def j13(spark, d):
    readings = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 1, "t1").otherwise("t").alias("tank"), (F.col("l_quantity") / 50 * 1.5).alias("height"), F.lit(1.2).alias("sensor_offset"))
    return G.volumes(readings, tank(spark)).select("l_orderkey", "l_linenumber", F.round("volume", 9).alias("volume"))


SIGNALS = "can_id bigint, origin string, name string, start_bit int, size int, big_endian boolean, signed boolean, factor double, offset double, min double, max double"


def can_frames(spark, d):
    """Frames of two little-endian words and one byte, from the numbers of events."""
    e = table(spark, d, "events")
    a, b = F.col("event_id") % 65536, F.col("user_id") % 65536
    word = lambda x: F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256).cast("long")), 2, "0"))
    payload = F.unhex(F.concat(word(a), word(b), F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), F.lit("000000")))
    return e.select("event_id", (F.lit(0x0CFEEE00).cast("long") + F.col("event_id") % 4).alias("can_id"), payload.alias("payload"))


@query(
    "p08_can_signals",
    """SELECT event_id, 'engine.temperature' AS path, event_id % 65536 * 0.5 - 40 AS value FROM events WHERE event_id % 65536 * 0.5 - 40 BETWEEN -40 AND 400
    UNION ALL SELECT event_id, 'engine.user', CAST(user_id % 65536 AS DOUBLE) FROM events
    UNION ALL SELECT event_id, 'engine.small', CAST(CASE WHEN event_id % 256 >= 128 THEN event_id % 256 - 256 ELSE event_id % 256 END AS DOUBLE) FROM events WHERE event_id % 256 <> 7""",
)
def p08(spark, d):
    signals = spark.createDataFrame(
        [
            (0x18FEEE27, "dbc", "t", 0, 16, False, False, 0.5, -40.0, -40.0, 400.0),
            (0x18FEEE27, "dbc", "u", 16, 16, False, False, 1.0, 0.0, 0.0, 70000.0),
            (0x18FEEE27, "dbc", "s", 39, 8, True, True, 1.0, 0.0, -200.0, 200.0),
            (0x18F00400, "dbc", "x", 0, 8, False, False, 1.0, 0.0, 0.0, 255.0),
        ],
        SIGNALS,
    )
    rules = spark.createDataFrame([("dbc", "t", "engine.temperature", None), ("dbc", "u", "engine.user", None), ("dbc", "s", "engine.small", [7.0])], "origin string, name string, path string, exclude array<double>")
    return G.decode_can(can_frames(spark, d), signals, rules).select("event_id", "path", "value")


@query("s09_packed_frames", "SELECT event_id, CAST(c AS INT) AS channel, CAST((event_id * (c + 1) * 37) % 65536 AS INT) AS word FROM events, range(6) t(c)")
def s09(spark, d):
    def three(c):
        w = F.col("event_id") * (c + 1) * 37 % 65536
        parts = [F.floor(w / 1024).cast("long") + (192 if c == 0 else 0), F.floor(w / 16).cast("long") % 64, w % 16 * 4]
        return [F.lpad(F.hex(p), 2, "0") for p in parts]

    frame = F.unhex(F.concat(*[p for c in range(6) for p in three(c)]))
    return G.unpack_channels(table(spark, d, "events").select("event_id", frame.alias("value")))


@query(
    "p09_sentences",
    """SELECT event_id, 'navigation.headingTrue' AS path, radians(CAST(event_id % 360 AS DOUBLE)) AS number FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'environment.depth.belowTransducer', CAST(event_id % 90 AS DOUBLE) FROM events WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, 'environment.depth.belowSurface', CAST(event_id % 90 AS DOUBLE) + 0.5 FROM events WHERE event_id % 3 = 1""",
)
def p09(spark, d):
    from ..functions.registry import checksum

    k = F.col("event_id")
    body = F.when(k % 3 == 0, F.concat(F.lit("HEHDT,"), k % 360, F.lit(",T"))).when(k % 3 == 1, F.concat(F.lit("SDDPT,"), k % 90, F.lit(",0.5"))).otherwise(F.lit("SDDPT,1,0"))
    value = F.concat(F.lit("$"), body, F.lit("*"), F.when(k % 3 == 2, "00").otherwise(checksum(body)))
    rows = N.sentences(table(spark, d, "events").select("event_id", value.alias("value")))
    return N.mapped_sentences(rows, "event_id").select("event_id", "path", "number")


#: Sentences of every kind, by event_id mod 20, with numbers from k = event_id mod 90; the SQL has their values.
BODIES = [
    "GPGLL,45{k:02}.50,N,123{k:02}.25,W,120000,A",
    "GPGGA,120000,45{k:02}.50,S,0{k:02}07.50,E,2,08,1.0,{k}.5,M,0,M,,",
    "GPRMC,120000,A,4530.00,N,12345.00,E,{k}.0,{k}.5,010124,,",
    "GPVTG,{k}.0,T,,M,10.0,N,18.5,K",
    "HEHDT,{k}.5,T",
    "TIROT,{k}.0,A",
    "SDDBT,1.0,f,{k}.25,M,0.5,F",
    "SDDPT,{k}.0,0.5",
    "SDDPT,{k}.0,-0.5",
    "WIMWV,{k}.0,R,10.0,N,A",
    "WIMWV,{k}.0,T,10.0,N,A",
    "VWVHW,{k}.0,T,1.0,M,5.0,N,9.3,K",
    "AIALR,120000,005,A,V,text {k}",
    "SDDBS,1.0,f,{k}.75,M,0.5,F",
    "HCHDM,{k}.0,M",
    "WIMTW,{k}.0,C",
    "WIMWD,{k}.0,T,10.0,M,20.0,N,,M",
    "WIMDA,29.9,I,1.0,B,{k}.0,C,11.0,C,50.0,,4.0,C,90.0,T,80.0,M,6.0,N,3.1,M",
    "AGRSA,{k}.0,A,5.0,V",
    "GPZDA,1200{s:02}.50,15,6,2024,00,00",
]


def _all_sentences() -> str:
    k, radians = "CAST(k AS DOUBLE)", "radians({})".format
    lat, lon = "navigation.position.latitude", "navigation.position.longitude"
    depth, wind, course, speed = "environment.depth.below", "environment.wind.", "navigation.courseOverGroundTrue", "navigation.speedOverGround"
    number = [
        (0, lat, f"45 + ({k} % 60 + 0.5) / 60"), (0, lon, f"-(123 + ({k} % 60 + 0.25) / 60)"), (1, lat, f"-(45 + ({k} % 60 + 0.5) / 60)"), (1, lon, f"{k} % 60 + 7.5 / 60"),
        (1, "navigation.position.altitude", f"{k} % 60 + 0.5"), (1, "navigation.gnss.satellites", "8.0"), (2, lat, "45.5"), (2, lon, "123.75"), (2, speed, f"{k} * 0.514444"), (2, course, radians(f"{k} + 0.5")),
        (3, course, radians(k)), (3, speed, "5.14444"), (4, "navigation.headingTrue", radians(f"{k} + 0.5")), (5, "navigation.rateOfTurn", f"radians({k}) / 60"), (6, depth + "Transducer", f"{k} + 0.25"),
        (7, depth + "Transducer", k), (7, depth + "Surface", f"{k} + 0.5"), (8, depth + "Transducer", k), (9, wind + "angleApparent", radians(k)), (9, wind + "speedApparent", "5.14444"),
        (11, "navigation.headingTrue", radians(k)), (11, "navigation.speedThroughWater", "2.57222"), (13, depth + "Surface", f"{k} + 0.75"), (14, "navigation.headingMagnetic", radians(k)),
        (15, "environment.water.temperature", f"{k} + 273.15"), (16, wind + "directionTrue", radians(k)), (16, wind + "directionMagnetic", radians("10.0")), (16, wind + "speedOverGround", "10.28888"),
        (17, "environment.outside.temperature", f"{k} + 273.15"), (17, "environment.water.temperature", "284.15"), (17, "environment.outside.humidity", "0.5"), (17, "environment.outside.dewPointTemperature", "277.15"),
        (17, wind + "directionTrue", radians("90.0")), (17, wind + "directionMagnetic", radians("80.0")), (17, wind + "speedOverGround", "3.1"), (18, "steering.rudderAngle", radians(k)),
    ]
    text = [(1, "navigation.gnss.methodQuality", "'DGNSS fix'"), (12, "notifications.ais", "'text ' || k"), (19, "navigation.datetime", "'2024-06-15T12:00:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || '.500Z'")]
    rows = [f"SELECT event_id, '{path}' AS path, round(CAST({x} AS DOUBLE), 6) AS number, CAST(NULL AS VARCHAR) AS text FROM e WHERE i = {i}" for i, path, x in number]
    rows += [f"SELECT event_id, '{path}', NULL, {x} FROM e WHERE i = {i}" for i, path, x in text]
    return "WITH e AS (SELECT event_id, event_id % 20 AS i, CASE WHEN event_id % 20 < 2 THEN event_id % 60 ELSE event_id % 90 END AS k FROM events) " + " UNION ALL ".join(rows)


@query("p09_all_sentences", _all_sentences())
def p09_all(spark, d):
    """Every kind of sentence and each of its values."""
    from ..functions.registry import checksum

    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 20).alias("i"))
    k = F.when(F.col("i") < 2, F.col("event_id") % 60).otherwise(F.col("event_id") % 90)
    two = F.lpad((k % 60).cast("string"), 2, "0")

    def filled(body: str):
        parts = [p for p in re.split(r"(\{.*?\})", body) if p]
        return F.concat(*[k.cast("string") if p == "{k}" else F.lpad(k.cast("string"), 2, "0") if p == "{k:02}" else two if p == "{s:02}" else F.lit(p) for p in parts])

    body = F.get(F.array(*map(filled, BODIES)), F.col("i").cast("int"))
    rows = N.sentences(e.select("event_id", F.concat(F.lit("$"), body, F.lit("*"), checksum(body)).alias("value")))
    return N.mapped_sentences(rows, "event_id").select("event_id", "path", F.round("number", 6).alias("number"), "text")


@query(
    "p10_ais_positions",
    """SELECT event_id, lpad(CAST(200000000 + user_id AS VARCHAR), 9, '0') AS mmsi, CAST(event_id % 1000 AS DOUBLE) / 10 * 0.514444 AS speed, radians(CAST(event_id % 3600 AS DOUBLE) / 10) AS course,
    radians(CAST(event_id % 360 AS DOUBLE)) AS heading, CAST(event_id * 31 % 1000000 - 500000 AS DOUBLE) / 600000 AS latitude, CAST(event_id * 77 % 1000000 - 500000 AS DOUBLE) / 600000 AS longitude FROM events""",
)
def p10(spark, d):
    k = F.col("event_id")
    wide = lambda x, n: F.lpad(F.substring(F.bin(x + (1 << n)), -n, n), n, "0")  # noqa: E731  two's complement
    bits = F.concat(
        wide(F.lit(1), 6), wide(F.lit(0), 2), wide(200000000 + F.col("user_id"), 30), wide(F.lit(0), 4), wide(F.lit(0), 8), wide(k % 1000, 10), wide(F.lit(0), 1),
        wide(k * 77 % 1000000 - 500000, 28), wide(k * 31 % 1000000 - 500000, 27), wide(k % 3600, 12), wide(k % 360, 9), wide(F.lit(0), 31),
    )
    letters = F.lit("".join(chr(v + (48 if v < 40 else 56)) for v in range(64)))
    letter = lambda b, i: F.substring(letters, F.conv(F.substring(b, i * 6 + 1, F.lit(6)), 2, 10).cast("int") + 1, F.lit(1))
    bound = F.transform(F.array(bits), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: letter(b, i)), ""))
    payload = F.element_at(bound, 1)
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("!AIVDM,1,1,,A,"), payload, F.lit(",0")).alias("value"))
    out = N.ais_positions(N.sentences(rows, allow_empty=True), "event_id")
    return out.select("event_id", "mmsi", "speed", "course", "heading", "latitude", "longitude")


@query("f11_fragments", "SELECT event_id FROM events WHERE event_id % 3 = 2")
def f11(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("!AIVDM,3,"), F.col("event_id") % 3 + 1, F.lit(",,A,x,0")).alias("value"))
    return N.whole_messages(N.sentences(rows, allow_empty=True)).select("event_id")


@query(
    "f12_checksum_options",
    "SELECT event_id, event_id % 3 = 0 AS strict, event_id % 3 < 2 AS empty_ok, event_id % 3 <> 1 AS mismatch_ok FROM events",
)
def f12(spark, d):
    value = F.when(F.col("event_id") % 3 == 0, "$GPX,1*52").when(F.col("event_id") % 3 == 1, "$GPX,1").otherwise("$GPX,1*00")
    rows = table(spark, d, "events").select("event_id", value.alias("value"))
    columns = {"strict": (False, False), "empty_ok": (True, False), "mismatch_ok": (False, True)}
    out = rows
    for name, (empty, mismatch) in columns.items():
        out = N.sentences(out, allow_empty=empty, allow_mismatch=mismatch).withColumn(name, F.col("valid")).drop("talker", "kind", "fields", "valid")
    return out.drop("value")


BLOCKS = f"""WITH {MAPPED}, o AS (SELECT context, path, time, arg_max(value, seq) AS value FROM mapped GROUP BY ALL),
  p AS (SELECT *, row_number() OVER w - 1 AS n, lead(time, 4) OVER w AS t, lead(time, 7) OVER w AS r FROM o WINDOW w AS (PARTITION BY context, path ORDER BY time)),
  s AS (SELECT context, path, n // 4 AS block, epoch_us(t) - epoch_us(time) AS us FROM p WHERE n % 4 = 0 AND r IS NOT NULL)"""


@query("w08_sample_blocks", f"{BLOCKS} SELECT p.context, p.path, s.block, CAST(n % 4 AS INT) AS place, value, us / 1e6 AS duration FROM p JOIN s ON p.context = s.context AND p.path = s.path AND n // 4 = s.block")
def w08(spark, d):
    return P.sample_blocks(mapped(spark, d), 4).select("context", "path", "block", F.col("place").cast("int").alias("place"), "value", "duration")


@query(
    "a12_spectrum",
    f"""{BLOCKS}, f AS (SELECT p.context, p.path, s.block, us / 1e6 AS duration, k, sum(value * cos(2 * pi() * k * (n % 4) / 4)) AS re, -sum(value * sin(2 * pi() * k * (n % 4) / 4)) AS im
      FROM p JOIN s ON p.context = s.context AND p.path = s.path AND n // 4 = s.block, range(3) t(k) GROUP BY ALL)
    SELECT context, path, block, round(2 * sqrt(pow(sum(re), 2) + pow(sum(im), 2)) / 4, 6) AS magnitude FROM f WHERE k <= 1 GROUP BY context, path, block""",
)
def a12(spark, d):
    """With so small a step the first bin closes at the first coefficient whose frequency isn't 0."""
    s = P.spectra(mapped(spark, d), 4, 1e-9)
    return s.select("context", "path", "block", F.round(F.element_at("coefficients", 1)["magnitude"], 6).alias("magnitude"))


@query(
    "a12_spectrum_bins",
    f"""WITH RECURSIVE {MAPPED}, o AS (SELECT origin, time, arg_max(value, seq) AS value FROM mapped GROUP BY ALL),
    p AS (SELECT *, row_number() OVER w - 1 AS n, lead(time, 64) OVER w AS t, lead(time, 127) OVER w AS r FROM o WINDOW w AS (PARTITION BY origin ORDER BY time)),
    s AS (SELECT origin, n // 64 AS block, (epoch_us(t) - epoch_us(time)) / 1e6 AS duration FROM p WHERE n % 64 = 0 AND r IS NOT NULL),
    f AS (SELECT p.origin, s.block, duration, k, sum(value * cos(2 * pi() * k * (n % 64) / 64)) AS re, -sum(value * sin(2 * pi() * k * (n % 64) / 64)) AS im
      FROM p JOIN s ON p.origin = s.origin AND n // 64 = s.block, range(33) t(k) GROUP BY ALL),
    b AS (SELECT origin, block, k, re, im, 0 AS bin, k / duration > 1e-5 AS closed FROM f WHERE k = 0
      UNION ALL SELECT f.origin, f.block, f.k, f.re + CASE WHEN closed THEN 0 ELSE b.re END, f.im + CASE WHEN closed THEN 0 ELSE b.im END,
        b.bin + CAST(closed AS INT), f.k / f.duration > (b.bin + CAST(closed AS INT)) * 2e-5 + 1e-5
      FROM b JOIN f ON f.origin = b.origin AND f.block = b.block AND f.k = b.k + 1)
    SELECT origin, CAST(block AS BIGINT) AS block, bin, round(2 * sqrt(re * re + im * im) / 64, 6) AS magnitude, round(2 * re / 64, 6) AS cosine FROM b WHERE closed""",
)
def a12_bins(spark, d):
    """Blocks of 64 samples, with a step of about three coefficients to a bin."""
    rows = mapped(spark, d).withColumn("context", F.col("origin")).withColumn("path", F.lit("all"))
    s = P.spectra(rows, 64, 2e-5).select(F.col("context").alias("origin"), "block", F.posexplode("coefficients").alias("bin", "c"))
    return s.select("origin", "block", "bin", F.round("c.magnitude", 6).alias("magnitude"), F.round(F.col("c.magnitude") * F.cos("c.phase"), 6).alias("cosine"))


LEG_ROWS = """r AS (SELECT context, seq, time, value AS speed, value > 20 AS moving FROM mapped WHERE path = 'click'),
  c AS (SELECT *, lag(moving) OVER w AS b, lag(speed) OVER w AS s, lag(time) OVER w AS t FROM r WINDOW w AS (PARTITION BY context ORDER BY time, seq)),
  g AS (SELECT *, sum(CASE WHEN moving <> b THEN 1 ELSE 0 END) OVER (PARTITION BY context ORDER BY time, seq) AS leg FROM c),
  legs AS (SELECT context, CAST(leg AS BIGINT) AS leg, moving, min(time) AS start, max(time) AS "end", round(sum(CASE WHEN moving = b THEN (epoch_us(time) - epoch_us(t)) / 1e6 * (speed + s) / 2 ELSE 0 END), 3) AS distance
    FROM g GROUP BY ALL)"""


def leg_table(spark, d):
    rows = mapped(spark, d).where("path = 'click'").withColumn("speed", F.col("value"))
    return Y.legs(rows, F.col("speed") > 20)


@query("e01_legs", f'WITH {MAPPED}, {LEG_ROWS} SELECT *, (epoch_us("end") - epoch_us(start)) / 1e6 AS seconds FROM legs')
def e01(spark, d):
    return leg_table(spark, d).withColumn("distance", F.round("distance", 3))


@query(
    "e02_great_circle",
    """SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(d - c) / 2), 2)))), 3) AS metres
    FROM (SELECT c_custkey, c_custkey % 80 AS a, c_custkey % 70 AS b, c_custkey % 170 AS c, c_custkey % 110 AS d FROM customer)""",
)
def e02(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.round(Y.great_circle(k % 80, k % 170, k % 70, k % 110), 3).alias("metres"))


@query(
    "e03_voyages",
    f"""WITH {MAPPED}, {LEG_ROWS}, m AS (SELECT *, lag("end") OVER (PARTITION BY context ORDER BY start) AS b FROM legs WHERE moving),
    v AS (SELECT *, sum(CASE WHEN b IS NULL OR epoch_us(start) - epoch_us(b) > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY context ORDER BY start) AS voyage FROM m)
    SELECT context, CAST(voyage AS BIGINT) AS voyage, min(start) AS start, max("end") AS "end", count(*) AS legs FROM v GROUP BY context, voyage""",
)
def e03(spark, d):
    return Y.voyages(leg_table(spark, d), 172800)


@query(
    "e04_level_events",
    f"""WITH {MAPPED}, l AS (SELECT *, value - lag(value) OVER (PARTITION BY context, path ORDER BY time, seq) AS delta FROM mapped)
    SELECT context, path, time, seq, delta FROM l WHERE abs(delta) >= 30""",
)
def e04(spark, d):
    return Y.level_events(mapped(spark, d), 30)
