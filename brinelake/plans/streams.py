"""Streaming jobs run to the end of what is there, over the same tables as their batch forms."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.upsert import registry_updates
from ..sources.staging import shared_path
from ..streaming import jobs as J
from .core import coarse, registry_rows
from .decoding import BLOCKS
from .feeds import MAPPED, mapped, table
from .registry import ORACLES, query
from .stateful import ARRIVAL, DELTA_SQL, LIMITED, register_numbers


#: The most that one trigger takes; so much of a key's rows is in one task at most.
TRIGGER_BYTES = 128 << 20
#: About as many rows has a trigger whose rows come in order.
PIECE_ROWS = 2_000_000


def mapped_stream(spark, d):
    """``mapped`` as a stream over the files of events."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES).parquet(f"{d}/events.parquet*")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    origin = F.concat(F.lit("v"), F.col("user_id") % 10)
    return events.select(
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("c"), k % 3).alias("connector"),
        F.when(k < 80, origin).otherwise(F.concat(F.lit("v"), 100 + F.col("user_id") % 50)).alias("context"),
        origin.alias("origin"),
        F.col("event_type").alias("path"),
        "value",
    )


@contextlib.contextmanager
def rocksdb(spark):
    """State in RocksDB for the streams started inside."""
    before = {k: spark.conf.get(k, None) for k in J.ROCKSDB}
    for k, v in J.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, at: str, mode: str = "append", write=None) -> None:
    """Runs the stream over all that is there, to rows in ``at``/rows or by the foreachBatch function ``write``."""
    out = stream.writeStream.option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True)
    if write is None and mode == "append":
        out = out.format("parquet").option("path", f"{at}/rows")
    else:
        out = out.foreachBatch(write or (lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/rows")))
    with rocksdb(stream.sparkSession):
        out.start().awaitTermination()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there; the result is a table of files in the shared folder."""
    spark = stream.sparkSession
    at = shared_path(spark, "stream")
    run_to_end(stream, at, mode)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def pieces(rows: DataFrame, by) -> list[DataFrame]:
    """The rows in order of ``by`` (a column of longs), in pieces of ``PIECE_ROWS`` or so; equal values stay together."""
    spark, n = rows.sparkSession, -(-rows.count() // PIECE_ROWS)
    if n < 2:
        return [rows]
    cuts = sorted(set(rows.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 10000)).first()[0]))
    at = shared_path(spark, "pieces")
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= by))
    rows.where(by.isNotNull()).withColumn("piece", number).write.partitionBy("piece").parquet(at)
    kept = spark.read.parquet(at)
    return [kept.where(F.col("piece") == k).select(*rows.columns) for k in range(len(cuts) + 1)]


def arriving(rows: DataFrame, parts, build, write=None, by=None) -> DataFrame | None:
    """Runs ``build(stream)`` over rows that arrive in parts, one after another, on one checkpoint.

    The rows of each condition are written by all tasks to the stream's folder, then the query takes them; so parts never mix, and
    the size of a trigger is bounded in bytes.  Triggers share out the files of a part, so its rows come in any order.  With ``by`` they
    come in that order: a part is cut into pieces of it, and each piece is one trigger.
    """
    spark, rows = rows.sparkSession, rows.withColumn("time", F.col("time").cast("timestamp"))
    at = shared_path(spark, "arrivals")
    stream = None
    for part in parts:
        for piece in [rows.where(part)] if by is None else pieces(rows.where(part), by):
            piece.write.mode("append").parquet(f"{at}/in")
            source = spark.readStream.schema(rows.schema)
            source = source.option("maxBytesPerTrigger", TRIGGER_BYTES) if by is None else source
            stream = build(source.parquet(f"{at}/in"))
            run_to_end(stream, at, write=write)
    return None if write else spark.read.schema(stream.schema).parquet(f"{at}/rows")


@query("t01_streaming_period_counts", f"WITH {MAPPED} SELECT time_bucket(INTERVAL 5 MINUTE, time) AS start, origin, count(*) AS count FROM mapped GROUP BY ALL")
def t01(spark, d):
    return finished(J.period_counts(mapped_stream(spark, d)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: The newest time, and rows that arrive an hour or more after all others.
NEWEST = "z AS (SELECT max(time) FILTER (WHERE seq % 10 > 0) AS newest FROM mapped)"


def late_tenth(spark, d):
    """Conditions of arrival: rows in time but each tenth, the last two hours of them, and then each tenth row, which is late."""
    newest = mapped(spark, d).where("seq % 10 > 0").agg(F.max("time")).first()[0]
    early = F.col("time") < F.lit(newest) - F.expr("INTERVAL 2 HOURS")
    in_time = F.col("seq") % 10 > 0
    return [in_time & early, in_time & ~early, F.col("time") == F.lit(newest), ~in_time]


@query(
    "t01_streaming_final_counts",
    f"""WITH {MAPPED}, {NEWEST}, a AS (SELECT mapped.*, time_bucket(INTERVAL 5 MINUTE, time) AS start FROM mapped, z
      WHERE seq % 10 > 0 OR time_bucket(INTERVAL 5 MINUTE, time) + INTERVAL 5 MINUTE > newest - INTERVAL 1 HOUR
      UNION ALL SELECT mapped.*, time_bucket(INTERVAL 5 MINUTE, time) FROM mapped, z WHERE time = newest)
    SELECT start, origin, count(*) AS count FROM a, z WHERE start + INTERVAL 5 MINUTE <= newest - INTERVAL 1 HOUR GROUP BY ALL""",
)
def t01_final(spark, d):
    """Periods are given once, when the watermark passes their end; rows that come later than that count nowhere."""
    return arriving(mapped(spark, d), late_tenth(spark, d), J.period_counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "t01_incremental_rollup",
    f"""WITH {MAPPED}, r AS (SELECT DISTINCT date_trunc('minute', time) AS time, origin, context, connector, path FROM mapped)
    SELECT time_bucket(INTERVAL 5 MINUTE, time) AS start, origin, count(*) AS count FROM r GROUP BY ALL""",
)
def t01_incremental(spark, d):
    """Counts kept up by triggers whose rows repeat stored keys, come late, and are delivered twice."""
    base, rollup = shared_path(spark, "base"), shared_path(spark, "rollup")
    rows = mapped(spark, d).drop("transfer_uuid", "type").withColumn("time", F.date_trunc("minute", "time"))
    arriving(rows, [F.col("seq") % 3 == k for k in range(3)], lambda stream: stream, twice(J.rollup_batches(base, rollup), rollup))
    out = J.VersionedTable(rollup, "date").read(spark, "start timestamp, origin string, count bigint, date date")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "origin", "count")


@query(
    "u04_streaming_absence",
    f"""WITH {MAPPED}, {NEWEST}, m AS (SELECT * FROM mapped, z WHERE seq % 10 > 0 AND (connector <> 'c2' OR time < newest - INTERVAL 3 HOURS))
    SELECT connector, max(time) AS last_seen FROM m, z GROUP BY connector HAVING max(time) + INTERVAL 30 MINUTE < max(z.newest) - INTERVAL 1 HOUR""",
)
def u04_absence(spark, d):
    """Sources that stay away at the end, one of them for hours: the watermark, which the others move, reports them."""
    newest = mapped(spark, d).where("seq % 10 > 0").agg(F.max("time")).first()[0]
    there = (F.col("seq") % 10 > 0) & ((F.col("connector") != "c2") | (F.col("time") < F.lit(newest) - F.expr("INTERVAL 3 HOURS")))
    early = F.col("time") < F.lit(newest) - F.expr("INTERVAL 2 HOURS")
    kind = "connector string, last_seen timestamp, next_seen timestamp"
    build = lambda stream: J.run_machine(stream.withWatermark("time", "1 hour"), ["connector"], J.Absence(1800), kind, "EventTime")
    seen = mapped(spark, d).select("time", "seq", "connector")
    # in order of time: rows of a later trigger would be late, or come after their source was reported
    rows = arriving(seen, [there & early, there & ~early, F.col("time") == F.lit(newest)], build, by=F.unix_micros("time"))
    # one that came back later has a row with that time too
    out = rows.where("next_seen is null").join(rows.where("next_seen is not null"), ["connector", "last_seen"], "left_anti")
    return out.select("connector", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


def thirds(spark, d):
    """Conditions of arrival: three parts, each later than the one before."""
    low, high = mapped(spark, d).agg(F.min("time"), F.max("time")).first()
    one, two = low + (high - low) / 3, low + 2 * (high - low) / 3
    t = F.col("time")
    return [t < F.lit(one), (t >= F.lit(one)) & (t < F.lit(two)), t >= F.lit(two)]


@query(
    "t05_streaming_life",
    f"""WITH RECURSIVE {MAPPED}, z AS (SELECT epoch_us(min(time)) AS low, epoch_us(max(time)) - epoch_us(min(time)) AS span FROM mapped),
    v AS (SELECT * REPLACE (CAST(floor(value / 40) AS BIGINT) AS value), CASE WHEN epoch_us(time) < low + span // 3 THEN 0 WHEN epoch_us(time) < low + 2 * span // 3 THEN 1 ELSE 2 END AS part FROM mapped, z),
    old AS (SELECT context, path, max(time) AS t, arg_max(value, struct_pack(a := time, b := seq)) AS x FROM v WHERE part = 0 GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY part, seq) AS n FROM v WHERE part > 0),
    scan AS (SELECT m.context, m.path, 0 AS n, CAST(NULL AS BIGINT) AS seq, t, x, false AS kept FROM m LEFT JOIN old ON m.context = old.context AND m.path = old.path WHERE n = 1
      UNION ALL SELECT m.context, m.path, m.n, m.seq, CASE WHEN c.x IS NULL OR m.value <> c.x OR m.time > c.t + INTERVAL 36 HOUR THEN m.time ELSE c.t END,
        CASE WHEN c.x IS NULL OR m.value <> c.x OR m.time > c.t + INTERVAL 36 HOUR THEN m.value ELSE c.x END, c.x IS NULL OR m.value <> c.x OR m.time > c.t + INTERVAL 36 HOUR
      FROM scan c JOIN m ON m.context = c.context AND m.path = c.path AND m.n = c.n + 1)
    SELECT seq, context, path FROM scan WHERE kept""",
)
def t05_life(spark, d):
    """New values over what was stored before the stream began; a stored value that is 36 hours old counts no more."""
    from datetime import timedelta

    low, high = mapped(spark, d).agg(F.min("time"), F.max("time")).first()
    span = (high - low) // timedelta(microseconds=1)
    one, two = (low + timedelta(microseconds=k * span // 3) for k in (1, 2))
    whole = F.floor(F.col("value") / 40).cast("long")
    stored = mapped(spark, d).where(F.col("time") < F.lit(one)).groupBy("context", "path").agg(F.max_by(F.struct("time", "value"), F.struct("time", "seq")).alias("r"))
    seed = stored.select("context", "path", F.col("r.time").cast("timestamp").alias("time"), F.col("r.value").alias("value")).withColumn("value", whole)
    t = F.col("time")
    rows = mapped(spark, d).withColumn("value", whole)
    build = lambda stream: J.run_machine(stream.withWatermark("time", "0 seconds"), ["context", "path"], J.NewValues(36 * 3600), None, "EventTime", seed)
    return arriving(rows, [(t >= F.lit(one)) & (t < F.lit(two)), t >= F.lit(two)], build).select("seq", "context", "path")


@query("t06_streaming_blocks", f"{BLOCKS} SELECT p.context, p.path, s.block, CAST(n % 4 AS INT) AS place, value, us / 1e6 AS duration FROM p JOIN s ON p.context = s.context AND p.path = s.path AND n // 4 = s.block")
def t06_blocks(spark, d):
    kind = "context string, path string, block bigint, place int, value double, duration double"
    return arriving(mapped(spark, d), thirds(spark, d), lambda stream: J.run_machine(stream, ["context", "path"], J.SampleBlocks(4), kind))


def averaged(rows, parts, lateness):
    """The stream of averages over rows that arrive in parts, and at last a row far in the future, which moves the watermark past them all."""
    end = rows.agg(F.max("time").alias("time")).select("time").first()[0]
    last = rows.limit(1).select(*[F.lit("~").alias(c) if c == "context" else F.lit(-1).cast("long").alias(c) if c == "seq" else (F.lit(end) + F.expr("INTERVAL 90 DAYS")).alias(c) if c == "time" else c for c in rows.columns])
    machine = J.MovingAverage(86400, 6 * 3600)
    build = lambda stream: J.run_machine(stream.withWatermark("time", lateness), ["context", "path"], machine, "seq bigint, average double", "EventTime")
    real = F.col("seq") >= 0
    out = arriving(rows.unionByName(last), [*[real & p for p in parts], ~real], build)
    return out.select("seq", F.round(F.when(~F.isnan("average"), F.col("average")), 6).alias("average"))


@query(
    "t03_streaming_average",
    f"""WITH {MAPPED} SELECT seq, round(avg(value) OVER (PARTITION BY context, path ORDER BY time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS average FROM mapped""",
)
def t03_average(spark, d):
    return averaged(mapped(spark, d).select("time", "seq", "context", "path", "value"), thirds(spark, d), "1 hour")


@query(
    "t03_streaming_late",
    f"""WITH {MAPPED}, n AS (SELECT * REPLACE (CASE WHEN seq % 4 > 0 THEN value END AS value) FROM mapped)
    SELECT seq, round(avg(value) OVER (PARTITION BY context, path ORDER BY time RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 6) AS average FROM n""",
)
def t03_late(spark, d):
    """Null values, and each fifth row of a part's last twelve hours arrives with the next part, an hour inside the watermark at least."""
    rows = mapped(spark, d).select("time", "seq", "context", "path", F.when(F.col("seq") % 4 > 0, F.col("value")).alias("value"))
    low, high = rows.agg(F.unix_micros(F.min("time").cast("timestamp")), F.unix_micros(F.max("time").cast("timestamp"))).first()
    width = (high - low) // 4 + 1
    past = F.unix_micros(F.col("time").cast("timestamp")) - low
    part = F.floor(past / width)
    held = (F.col("seq") % 5 == 0) & ((part + 1) * width - past <= 12 * 3600 * 1_000_000)
    arrival = part + held.cast("long")
    return averaged(rows, [arrival == k for k in range(5)], "13 hours")


@query(
    "t07_streaming_batches",
    f"""WITH {MAPPED}, m AS (SELECT *, seq % 3 AS trigger, row_number() OVER (PARTITION BY seq % 3 ORDER BY seq) - 1 AS n FROM mapped)
    SELECT trigger, n // 101 AS batch, '[' || string_agg('{{"context":"' || context || '","path":"' || path || '"}}', ',' ORDER BY seq) || ']' AS payload FROM m GROUP BY ALL""",
)
def t07_batches(spark, d):
    """Batches of a stream, flushed by count or by the trigger."""
    at = shared_path(spark, "batches")
    write = J.batch_writer(at, F.to_json(F.struct("context", "path")), 100)
    arriving(mapped(spark, d), [F.col("seq") % 3 == k for k in range(3)], lambda stream: stream, write)
    return spark.read.parquet(at).select(F.col("trigger").cast("bigint").alias("trigger"), "batch", "payload")


@query(
    "t07_streaming_flush",
    f"""WITH {MAPPED}, m AS (SELECT seq % 10 AS shard, '{{"seq":' || seq || ',"path":"' || path || '"}}' AS text, seq,
      row_number() OVER (PARTITION BY seq % 10 ORDER BY seq % 3, seq) - 1 AS n FROM mapped)
    SELECT shard, n // 41 AS batch, count(*) AS n, '[' || string_agg(text, ',' ORDER BY n) || ']' AS payload FROM m GROUP BY shard, n // 41""",
)
def t07_flush(spark, d):
    """Batches of each writer's share, of exactly so many across triggers; a timer flushes what is left in the end.

    Parts arrive a second apart and nothing comes after them, so the watermark, which a row of a day later moves, says when the time is over; by the clock,
    a part that takes long to write would be cut off from what is left of the one before it.
    """
    second = F.timestamp_seconds(86400 + F.col("seq") % 3)  # a watermark begins at 0
    rows = mapped(spark, d).select(second.alias("time"), "seq", (F.col("seq") % 10).alias("shard"), F.to_json(F.struct("seq", "path")).alias("text"))
    last = spark.range(1).select(F.timestamp_seconds(F.lit(2 * 86400)).alias("time"), F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("shard"), F.lit("").alias("text"))
    machine = J.Flush(40, 20, ["shard"], event_time=True)
    kind = "shard bigint, batch bigint, n bigint, payload string"
    build = lambda stream: J.run_machine(stream.withWatermark("time", "10 seconds"), ["shard"], machine, kind, "EventTime")
    real = F.col("seq") >= 0
    return arriving(rows.unionByName(last), [*[real & (F.col("seq") % 3 == k) for k in range(3)], ~real], build, by=F.col("seq"))


def twice(write, path):
    """The foreachBatch function that delivers every trigger again, after rows that a failed one has left without a manifest."""

    def deliver(batch, number):
        batch.sparkSession.range(3).write.parquet(f"{path}/data/{number}-failed/part=all")
        write(batch, number)
        write(batch, number)

    return deliver


@query("w03_streaming_delta", f"""{DELTA_SQL} SELECT seq, address AS register, CASE WHEN b IS NULL AND f THEN word WHEN step < -50000 THEN step + 65535
  WHEN step > 50000 THEN step - 65535 ELSE step END AS delta, date_diff('microsecond', t, time) // 1000 AS time_delta FROM s""")
def w03_stream(spark, d):
    """Register deltas over three triggers: a map of registers under each slave."""
    n = register_numbers(spark, d).where("word NOT IN (0, 32767, 32768)")
    rows = n.select("time", "seq", "connector", "slave", F.col("address").alias("register"), "word")
    kind = "seq bigint, register int, delta bigint, time_delta bigint"
    return arriving(rows, thirds(spark, d), lambda stream: J.run_machine(stream, ["connector", "slave"], J.RegisterDeltas(), kind))


@query("k04_streaming_registry", ORACLES["k04_registry"])
def k04_stream(spark, d):
    """The registry, merged column by column and trigger by trigger; each trigger is delivered twice, and some fail before they are committed."""
    path = shared_path(spark, "registry")
    m = registry_rows(spark, d).withColumn("time", F.lit("2024-01-01").cast("timestamp"))
    parts = [F.col("seq") % 10 == 0, F.col("seq") % 10 > 6]
    arriving(m, parts, lambda stream: stream, twice(J.registry_batches(path), path))
    table_of = J.VersionedTable(path)
    return table_of.read(spark, registry_updates(m.limit(0)).schema)


@query("a14_streaming_counts", ORACLES["a14_latest_counts"])
def a14_stream(spark, d):
    """Counts of periods, of which a later trigger may have newer ones, written by days; triggers are delivered twice."""
    path = shared_path(spark, "counts")
    rows = coarse(spark, d).select("time", F.col("time").alias("start"), "origin", (F.col("seq") % 100).alias("count"), "seq")
    arriving(rows, [F.col("seq") % 2 == 0, F.col("seq") % 2 == 1], lambda stream: stream.drop("time"), twice(J.count_batches(path), path))
    out = J.VersionedTable(path, "date").read(spark, "date date, start timestamp_ntz, origin string, count bigint, seq bigint")
    return out.select("start", "origin", "count")


@query("t09_streaming_redelivery", f"WITH {MAPPED} SELECT count(*) AS n FROM (SELECT DISTINCT time, origin, context, connector, path FROM mapped)")
def t09(spark, d):
    return finished(J.without_redelivery(mapped_stream(spark, d))).agg(F.count("*").alias("n"))


@query("u04_streaming_rate_limit", f"{LIMITED} SELECT seq, context, path FROM scan WHERE kept")
def u04_rate(spark, d):
    return finished(J.run_machine(mapped_stream(spark, d), ["context", "path", "connector"], J.RateLimit(6 * 3600))).select("seq", "context", "path")


@query(
    "u04_streaming_combine",
    f"""WITH {MAPPED}, k AS (SELECT *, last_value(CASE WHEN path = 'click' THEN value END IGNORE NULLS) OVER w AS a,
      last_value(CASE WHEN path = 'view' THEN value END IGNORE NULLS) OVER w AS b FROM mapped WHERE path IN ('click', 'view')
      WINDOW w AS (PARTITION BY context ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT context, seq, a + b AS value FROM k WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def u04_combine(spark, d):
    machine = J.Combine(["click", "view"], lambda a, b: a + b)
    return finished(J.run_machine(mapped_stream(spark, d), ["context"], machine, "context string, time timestamp, value double, seq bigint")).select("context", "seq", "value")


@query(
    "u04_streaming_silence",
    f"""WITH {MAPPED} SELECT connector, time AS last_seen, n AS next_seen FROM (SELECT *, lead(time) OVER (PARTITION BY connector
    ORDER BY time, seq) AS n FROM mapped) WHERE n > time + INTERVAL 30 MINUTE""",
)
def u04_silence(spark, d):
    out = finished(J.run_machine(mapped_stream(spark, d), ["connector"], J.Silence(1800), "connector string, last_seen timestamp, next_seen timestamp"))
    return out.select("connector", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.col("next_seen").cast("timestamp_ntz").alias("next_seen"))


ENVELOPE = """'{"connector":"c' || event_id % 3 || '","timestamp":"2024-01-01T00:00:00Z","type":"t"' || CASE WHEN event_id % 7 = 0 THEN '' ELSE ',"uuid":"u' || event_id || '"' END || ',"value":"' || v || '"}'"""


@query("s01_raw_envelopes", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'uuid is missing' END AS reason, CASE WHEN event_id % 7 <> 0 THEN event_type END AS value FROM events")
def s01(spark, d):
    from ..sources.envelopes import raw_messages

    e = table(spark, d, "events").withColumn("v", F.base64(F.concat("event_id", F.lit("/"), "event_type").cast("binary")))
    out = raw_messages(e.select(F.expr(ENVELOPE).alias("value")))
    text = F.split(out["value"].cast("string"), "/")
    return out.select(text[0].cast("bigint").alias("event_id"), "reason", F.when(F.col("reason").isNull(), text[1]).alias("value"))


@query("s02_delta_messages", f"WITH {MAPPED} SELECT seq, context, origin, path, CAST(floor(value) AS BIGINT) AS value FROM mapped")
def s02(spark, d):
    from ..operators.flatten import rebuild
    from ..sources.envelopes import delta_messages
    m = rebuild(mapped(spark, d).withColumn("value", F.floor("value").cast("long")).withColumn("uuid", F.col("seq").cast("string")))
    out = delta_messages(m.select(F.to_json(F.struct("*")).alias("value"))).where("reason is null")
    rows = out.select("context", "origin", F.explode("updates").alias("u")).select("context", "origin", "u.source.uuid", F.explode("u.values").alias("v"))
    return rows.select(F.col("uuid").cast("bigint").alias("seq"), "context", "origin", F.col("v.path").alias("path"), F.try_variant_get("v.value", "$", "bigint").alias("value"))


@query("s03_single_values", f"WITH {MAPPED} SELECT seq, context, path, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM mapped")
def s03(spark, d):
    from ..sources.envelopes import single_values
    m = mapped(spark, d)
    source = F.struct(F.col("connector").alias("label"), "type", F.col("seq").cast("string").alias("uuid"))
    text = F.to_json(F.struct("context", "origin", "path", F.floor("value").cast("long").alias("value"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), source.alias("source")))
    out = single_values(m.select(text.alias("value"))).where("reason is null")
    return out.select(F.col("uuid").cast("bigint").alias("seq"), "context", "path", "value")


@query("s04_batch_envelopes", f"WITH {MAPPED} SELECT context, origin, count(*) AS n_updates, count(*) FILTER (WHERE seq % 4 = 0) AS n_transferred FROM mapped GROUP BY ALL")
def s04(spark, d):
    from ..operators.export import batches
    from ..operators.flatten import rebuild
    from ..sources.envelopes import batch_messages
    m = mapped(spark, d).withColumn("transfer_uuid", F.when(F.col("seq") % 4 == 0, F.lit("t")))
    deltas = rebuild(m, "seq")
    out = batch_messages(batches(deltas, F.to_json(F.struct("context", "origin", "updates")), 100).select(F.col("payload").alias("value")))
    return out.groupBy("context", "origin").agg(F.sum("n_updates").alias("n_updates"), F.sum("n_transferred").alias("n_transferred"))


@query("t05_streaming_latest", f"WITH {MAPPED} SELECT DISTINCT ON (context, path) context, path, seq, value FROM mapped ORDER BY context, path, time DESC, seq DESC")
def t05(spark, d):
    return finished(J.latest(mapped_stream(spark, d)), "complete").select("context", "path", "seq", "value")


@query(
    "u04_streaming_changes",
    f"""WITH RECURSIVE {MAPPED}, s AS (SELECT * REPLACE ((seq * 7919) % 10007 AS seq, CAST(floor(value / 40) AS BIGINT) AS value) FROM mapped),
    m AS (SELECT *, row_number() OVER (PARTITION BY context, path ORDER BY seq) AS n FROM s),
    scan AS (SELECT context, path, n, seq, time AS t, value AS x, true AS kept FROM m WHERE n = 1
      UNION ALL SELECT m.context, m.path, m.n, m.seq, CASE WHEN m.time >= c.t AND m.value <> c.x THEN m.time ELSE c.t END,
        CASE WHEN m.time >= c.t AND m.value <> c.x THEN m.value ELSE c.x END, m.time >= c.t AND m.value <> c.x
      FROM scan c JOIN m ON m.context = c.context AND m.path = c.path AND m.n = c.n + 1)
    SELECT seq, context, path FROM scan WHERE kept""",
)
def u04_changes(spark, d):
    stream = mapped_stream(spark, d).withColumns({"event": F.col("seq"), "seq": (F.col("seq") * 7919) % 10007, "value": F.floor(F.col("value") / 40).cast("long")})
    return finished(J.run_machine(stream, ["context", "path"], J.Changes(tuple(ARRIVAL)))).select("seq", "context", "path")


@query(
    "k02_streaming_upsert",
    f"""WITH {MAPPED}, m AS (SELECT time_bucket(INTERVAL 1 DAY, time) AS time, * EXCLUDE (time) FROM mapped)
    SELECT time, origin, context, connector, path, arg_max(value, seq) AS value, min(seq) AS seq FROM m GROUP BY ALL""",
)
def k02_stream(spark, d):
    path = shared_path(spark, "upserts")
    stream = mapped_stream(spark, d).withColumn("time", F.date_trunc("day", "time"))
    for delivery in (1, 2):  # the second changes nothing
        q = stream.writeStream.option("checkpointLocation", shared_path(spark, f"state{delivery}")).foreachBatch(J.upsert_batches(path)).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = J.VersionedTable(path, "date").read(spark, stream.withColumns({"date": F.to_date("time"), "own_context": F.lit(True)}).schema)
    return rows.select(F.col("time").cast("timestamp_ntz").alias("time"), "origin", "context", "connector", "path", "value", "seq")


@query("k01_raw_append", "SELECT event_id AS seq, event_type AS value, CAST(ts AS DATE) AS date FROM events")
def k01(spark, d):
    from ..operators.upsert import append

    path = shared_path(spark, "raw")
    e = table(spark, d, "events").select(F.col("ts").alias("time"), F.col("event_id").alias("seq"), F.col("event_type").cast("binary").alias("value"))
    for part in (0, 1):
        append(e.where(F.col("seq") % 2 == part), path)
    return spark.read.parquet(path).select("seq", F.col("value").cast("string").alias("value"), "date")


@query("s05_line_source", "SELECT 'line ' || event_id AS value, 'c0' AS connector, 'text' AS type FROM events")
def s05(spark, d):
    from ..sources.envelopes import lines

    path = shared_path(spark, "lines")
    table(spark, d, "events").select(F.concat(F.lit("line "), "event_id")).write.text(path)
    return lines(spark, path, "c0", "text").select(F.col("value").cast("string").alias("value"), "connector", "type")
