"""Rollups, latest values, upserts and other set queries over mapped rows."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..operators import latest, rollup, upsert
from ..sources.staging import shared_path
from .feeds import MAPPED, mapped, table
from .registry import query

BUCKET = "time_bucket(INTERVAL 5 MINUTE, time)"
WITH = f"WITH {MAPPED}, counts AS (SELECT {BUCKET} AS start, origin, count(*) AS count FROM mapped GROUP BY ALL)"
COARSE = "SELECT time_bucket(INTERVAL 1 DAY, time) AS time, * EXCLUDE (time) FROM mapped"


def coarse(spark, d):
    """Mapped rows with times cut to days, so that keys repeat; the first half by seq is what is stored."""
    return mapped(spark, d).withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz"))


@query("a01_period_counts", f"{WITH} SELECT * FROM counts")
def a01(spark, d):
    return rollup.period_counts(mapped(spark, d))


@query(
    "a02_rollup_of_rollups",
    f"""WITH {MAPPED}, parts AS (
      SELECT {BUCKET} AS start, origin, count(*) AS count FROM mapped WHERE context = origin GROUP BY ALL
      UNION ALL SELECT {BUCKET}, origin, count(*) FROM mapped WHERE context <> origin GROUP BY ALL)
    SELECT start, origin, CAST(sum(count) AS BIGINT) AS count FROM parts GROUP BY ALL""",
)
def a02(spark, d):
    m = mapped(spark, d)
    own = F.col("context") == F.col("origin")
    return rollup.merge_counts(rollup.period_counts(m.where(own)), rollup.period_counts(m.where(~own)))


@query("a03_first_period", f"{WITH} SELECT origin, min(start) AS start FROM counts GROUP BY origin")
def a03(spark, d):
    return rollup.first_period(rollup.period_counts(mapped(spark, d)))


@query("a04_earliest_period", f"{WITH} SELECT coalesce(min(start), TIMESTAMP '2030-01-01') AS start FROM counts")
def a04(spark, d):
    return rollup.earliest(rollup.period_counts(mapped(spark, d)), F.expr("timestamp_ntz'2030-01-01'"))


@query(
    "a05_rows_per_uuid",
    f"""{WITH} SELECT c.origin, c.start, uuid, count(*) AS count FROM counts c JOIN mapped m
    ON m.origin = c.origin AND m.time BETWEEN c.start AND c.start + INTERVAL 5 MINUTE GROUP BY ALL""",
)
def a05(spark, d):
    m = mapped(spark, d)
    return rollup.rows_per_uuid(m, rollup.period_counts(m))


@query(
    "a07_count_lookup",
    f"""{WITH} SELECT k.origin, k.start, coalesce(c.count, 0) AS count
    FROM (SELECT origin, start + INTERVAL 5 MINUTE AS start FROM counts) k LEFT JOIN counts c ON c.origin = k.origin AND c.start = k.start""",
)
def a07(spark, d):
    counts = rollup.period_counts(mapped(spark, d))
    return rollup.look_up(counts, counts.select("origin", rollup.period_end().alias("start")))


@query("a09_period_bounds", f"{WITH} SELECT min(start) AS first_start, max(start) AS last_start FROM counts")
def a09(spark, d):
    return rollup.bounds(rollup.period_counts(mapped(spark, d)))


@query(
    "a13_transfer_counters",
    f"""WITH {MAPPED} SELECT count(DISTINCT seq) AS messages, count(*) FILTER (WHERE seq % 4 = 0) AS transferred,
    count(DISTINCT uuid) AS uuids, count(*) AS records FROM mapped""",
)
def a13(spark, d):
    return rollup.transfer_counters(mapped(spark, d).withColumn("transfer_uuid", F.when(F.col("seq") % 4 == 0, F.lit("t"))))


@query(
    "a14_latest_counts",
    f"""WITH {MAPPED}, arrivals AS (SELECT time_bucket(INTERVAL 1 DAY, time) AS start, origin, CAST(k AS BIGINT) AS count, seq
      FROM (SELECT *, seq % 100 AS k FROM mapped))
    SELECT start, origin, arg_max(count, seq) AS count FROM arrivals GROUP BY ALL""",
)
def a14(spark, d):
    return rollup.latest_counts(coarse(spark, d).select(F.col("time").alias("start"), "origin", (F.col("seq") % 100).alias("count"), "seq"))


COLUMNS = "context, path, time, seq, connector, type, origin, value, uuid"


@query(
    "w01_latest",
    f"""WITH {MAPPED} SELECT DISTINCT ON (context, path) {COLUMNS} FROM mapped
    WHERE time > (SELECT min(time) + INTERVAL 1 DAY FROM mapped) ORDER BY context, path, time DESC, seq DESC""",
)
def w01(spark, d):
    m = mapped(spark, d)
    since = m.agg(F.min("time")).scalar() + F.expr("INTERVAL 1 DAY")
    return latest.latest(m, since).select(*COLUMNS.split(", "))


@query(
    "w02_duplicates",
    f"""WITH {MAPPED}, twice AS (SELECT time, connector, context, origin, path, value, seq FROM mapped
      UNION ALL SELECT time, connector, context, origin, path, value, seq + 1000000000 FROM mapped WHERE seq % 3 = 0)
    SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY time, connector, context, origin, path, value ORDER BY seq) = 1""",
)
def w02(spark, d):
    keys = ["time", "connector", "context", "origin", "path", "value"]
    m = mapped(spark, d).select(*keys, "seq")
    return latest.without_duplicates(m.unionByName(m.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1000000000)), keys)


@query(
    "w06_last_known",
    f"""WITH {MAPPED} SELECT seq, context, path, last_value(v IGNORE NULLS) OVER (PARTITION BY context, path ORDER BY time, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_value
    FROM (SELECT *, CASE WHEN seq % 4 <> 0 THEN value END AS v FROM mapped)""",
)
def w06(spark, d):
    m = mapped(spark, d).withColumn("value", F.when(F.col("seq") % 4 != 0, F.col("value")))
    return latest.carried(m).select("seq", "context", "path", "last_value")


LEAF_SQL = """'{"value":' || CAST(value AS VARCHAR) || ',"timestamp":"' || strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ')
  || '","source":{"label":"' || connector || '","type":"' || type || '","uuid":"' || uuid || '"}}'"""


def whole(m):
    """Values as whole numbers, so that both engines print them alike."""
    return m.withColumn("value", F.floor("value").cast("long"))


LATEST_WHOLE = f"""l AS (SELECT DISTINCT ON (context, path) * REPLACE (CAST(floor(value) AS BIGINT) AS value) FROM mapped ORDER BY context, path, time DESC, seq DESC)"""


@query(
    "k10_model_document",
    f"""WITH {MAPPED}, {LATEST_WHOLE}
    SELECT context, '{{' || string_agg('"' || path || '":' || {LEAF_SQL}, ',' ORDER BY path) || '}}' AS document FROM l GROUP BY context""",
)
def k10(spark, d):
    return latest.documents(whole(mapped(spark, d)))


#: Paths of one to four parts, some of them beginnings of others, a key with quotes, and vessel information on the empty path.
TREE = """t AS (SELECT time, seq, connector, type, context, uuid, CASE seq % 8 WHEN 0 THEN path WHEN 1 THEN path || '.rate' WHEN 2 THEN path || '.rate.max' WHEN 3 THEN path || '.a "b"'
    WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN path || '.rate.max.day' ELSE path || '.value.x' END AS path,
    CASE seq % 8 WHEN 0 THEN CAST(seq AS VARCHAR) WHEN 1 THEN '{"latitude":' || seq || '}' WHEN 2 THEN '"t' || seq || '"' WHEN 3 THEN '[' || seq || ',2]' WHEN 4 THEN '{"mmsi":"' || seq || '"}'
    WHEN 5 THEN '{"name":"n ' || seq || '"}' WHEN 6 THEN 'true' ELSE 'x' || seq END AS value FROM mapped),
  l AS (SELECT DISTINCT ON (context, path) *, string_split(path, '.') AS p FROM t WHERE path <> '' ORDER BY context, path, time DESC, seq DESC),
  leaf AS (SELECT context, p, '"source":{"label":"' || connector || '","type":"' || type || '","uuid":"' || uuid || '"},"timestamp":"' || strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') || '","value":'
      || CASE WHEN value LIKE 'x%' THEN '"' || value || '"' ELSE value END AS text FROM l
    WHERE NOT (len(p) > 2 AND p[2] = 'value' AND EXISTS (SELECT 1 FROM l o WHERE o.context = l.context AND o.path = l.p[1]))),
  info AS (SELECT context, arg_max(value, (time, seq)) FILTER (WHERE seq % 8 = 4) AS mmsi, arg_max(value, (time, seq)) FILTER (WHERE seq % 8 = 5) AS name FROM t WHERE path = '' GROUP BY context),
  n4 AS (SELECT context, p[1:3] AS p, '"' || p[4] || '":{' || text || '}' AS text, p[4] AS k FROM leaf WHERE len(p) = 4),
  n3 AS (SELECT context, p[1:2] AS p, '"' || p[3] || '":{' || string_agg(text, ',' ORDER BY k) || '}' AS text, p[3] AS k
    FROM (SELECT context, p, '' AS k, text FROM leaf WHERE len(p) = 3 UNION ALL SELECT context, p, k, text FROM n4) GROUP BY context, p),
  n2 AS (SELECT context, p[1:1] AS p, '"' || replace(p[2], '"', chr(92) || '"') || '":{' || string_agg(text, ',' ORDER BY k) || '}' AS text, p[2] AS k
    FROM (SELECT context, p, '' AS k, text FROM leaf WHERE len(p) = 2 UNION ALL SELECT context, p, k, text FROM n3) GROUP BY context, p),
  n1 AS (SELECT context, '"' || p[1] || '":{' || string_agg(text, ',' ORDER BY k) || '}' AS text, p[1] AS k
    FROM (SELECT context, p, '' AS k, text FROM leaf WHERE len(p) = 1 UNION ALL SELECT context, p, k, text FROM n2) GROUP BY context, p)"""


def tree_rows(spark, d):
    k, path = F.col("seq"), F.col("path")
    paths = [path, F.concat(path, F.lit(".rate")), F.concat(path, F.lit(".rate.max")), F.concat(path, F.lit('.a "b"')), F.lit(""), F.lit(""), F.concat(path, F.lit(".rate.max.day")), F.concat(path, F.lit(".value.x"))]
    text = k.cast("string")
    wrapped = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    values = [text, wrapped('{"latitude":', "}"), wrapped('"t', '"'), wrapped("[", ",2]"), wrapped('{"mmsi":"', '"}'), wrapped('{"name":"n ', '"}'), F.lit("true"), wrapped("x", "")]
    of = lambda cases: F.get(F.array(*cases), (k % 8).cast("int"))
    return mapped(spark, d).select("time", "seq", "connector", "type", F.concat(F.lit("vessels."), "context").alias("context"), "uuid", of(values).alias("value"), of(paths).alias("path"))


@query(
    "k10_model_tree",
    f"""WITH {MAPPED}, {TREE}, a AS (SELECT context, text, k FROM n1
      UNION ALL SELECT context, '"mmsi":' || substr(mmsi, 9, length(mmsi) - 9), 'mmsi' FROM info WHERE mmsi IS NOT NULL UNION ALL SELECT context, '"name":' || substr(name, 9, length(name) - 9), 'name' FROM info WHERE name IS NOT NULL)
    SELECT 'vessels.' || context AS context, 'vessels' AS root, context AS name, '{{' || string_agg(text, ',' ORDER BY k) || '}}' AS document FROM a GROUP BY context""",
)
def k10_tree(spark, d):
    return latest.model_tree(tree_rows(spark, d))


@query(
    "k11_pointer",
    f"""WITH {MAPPED}, {TREE} SELECT 'vessels.' || context AS context, CASE path WHEN 'click.rate.max' THEN value ELSE '"' || uuid || '"' END AS document FROM l
    WHERE context = 'v1' AND path IN ('click.rate.max', 'view.a "b"') OR context = 'v2' AND path = 'click'""",
)
def k11_pointer(spark, d):
    """Pointers into leaves; their conditions on context and path reach the scan."""
    rows = tree_rows(spark, d)
    found = [latest.pointer(rows, f"/vessels/{p}") for p in ("v1/click/rate/max/value", 'v1/view/a "b"/source/uuid', "v2/click/source/uuid")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "k11_subtree",
    f"""WITH {MAPPED}, {LATEST_WHOLE} SELECT context AS root, '' AS name, context, path, {LEAF_SQL} AS leaf FROM l
    WHERE context = 'v1' AND (path = 'click' OR path LIKE 'click.%')""",
)
def k11(spark, d):
    return latest.subtree(whole(mapped(spark, d)), F.lit("v1"), "click")


@query(
    "k02_upsert",
    f"""WITH {MAPPED}, m AS ({COARSE}) SELECT time, origin, context, connector, path, arg_max(value, seq) AS value,
    min(seq) AS seq, arg_min(type, seq) AS type, arg_min(uuid, seq) AS uuid FROM m GROUP BY ALL""",
)
def k02(spark, d):
    m = coarse(spark, d)
    return upsert.upsert(m.where("seq % 2 = 0"), m.where("seq % 2 = 1")).drop("transfer_uuid")


@query("k03_context_split", f"WITH {MAPPED} SELECT CAST(time AS DATE) AS date, context = origin AS own_context, count(*) AS n FROM mapped GROUP BY ALL")
def k03(spark, d):
    return upsert.split_by_context(mapped(spark, d)).groupBy("date", "own_context").agg(F.count("*").alias("n"))


REGISTRY_PATHS = "['" + "','".join(p for p, _ in upsert.REGISTRY.values()) + "']"


def registry_rows(spark, d):
    """Mapped rows on the seven registry paths, with values as JSON text."""
    n = F.floor("value").cast("long").cast("string")
    path = F.element_at(F.array(*[F.lit(p) for p, _ in upsert.REGISTRY.values()]), (F.col("seq") % 7 + 1).cast("int"))
    text = F.concat(F.lit('"n'), n, F.lit('"'))
    value = (
        F.when(F.col("path") == "design.length", F.concat(F.lit('{"overall":'), n, F.lit("}")))
        .when(F.col("path") == "design.beam", n)
        .when(F.col("path") == "design.aisShipType", F.concat(F.lit('{"id":1,"description":'), text, F.lit("}")))
        .otherwise(text)
    )
    return mapped(spark, d).withColumn("path", path).withColumn("value", value)


def registry_sql(name: str, where: str) -> str:
    columns = ", ".join(f"arg_max({'CAST(n AS DOUBLE)' if c in upsert.NUMBERS else chr(39) + 'n' + chr(39) + ' || n'}, seq) FILTER (WHERE path = '{p}') AS {c}" for c, (p, _) in upsert.REGISTRY.items())
    return f"{name} AS (SELECT context, {columns} FROM r WHERE {where} GROUP BY context)"


REGISTRY_ROWS = f"r AS (SELECT context, seq, list_extract({REGISTRY_PATHS}, CAST(seq % 7 + 1 AS INT)) AS path, CAST(floor(value) AS BIGINT) AS n FROM mapped)"


@query(
    "k04_registry",
    f"""WITH {MAPPED}, {REGISTRY_ROWS}, {registry_sql("a", "seq % 10 = 0")}, {registry_sql("b", "seq % 10 > 6")}
    SELECT coalesce(b.context, a.context) AS context, {', '.join(f"coalesce(b.{c}, a.{c}) AS {c}" for c in upsert.REGISTRY)} FROM a FULL JOIN b ON a.context = b.context""",
)
def k04(spark, d):
    """Updates over stored rows: what they don't give stays, and contexts of either side remain."""
    m = registry_rows(spark, d)
    return upsert.merge_registry(upsert.registry_updates(m.where("seq % 10 = 0")), upsert.registry_updates(m.where("seq % 10 > 6")))


@query("k12_transfer_log", f"{WITH} SELECT start + INTERVAL 5 MINUTE AS time, origin, '{{\"count\":' || count || '}}' AS message FROM counts")
def k12(spark, d):
    return upsert.log_rows(rollup.period_counts(mapped(spark, d)), rollup.period_end(), F.struct("count"))


@query("k13_retention", f"WITH {MAPPED} SELECT seq, time FROM mapped WHERE time >= (SELECT max(time) FROM mapped) - INTERVAL 7 DAY")
def k13(spark, d):
    m = mapped(spark, d)
    return upsert.retain(m, m.agg(F.max("time")).scalar(), "7 DAYS").select("seq", "time")


@query("k13_partitioned_retention", f"WITH {MAPPED} SELECT seq, origin, CAST(time AS DATE) AS date FROM mapped WHERE time >= (SELECT max(time) FROM mapped) - INTERVAL 7 DAY")
def k13_partitioned(spark, d):
    """Retention of a stored table: whole days are pruned before anything is read."""
    path = shared_path(spark, "mapped")
    m = mapped(spark, d)
    upsert.append(m, path)
    newest = m.agg(F.max("time")).first()[0]
    return upsert.retain(spark.read.parquet(path), F.lit(newest), "7 DAYS").select("seq", "origin", "date")


@query(
    "a13_observed_transfers",
    f"WITH {MAPPED} SELECT count(*) AS records, count(*) FILTER (WHERE seq % 4 = 0) AS transferred, max(time) AS newest FROM mapped",
)
def a13_observed(spark, d):
    """Counters that a write gives beside what it writes."""
    observation = Observation("transfers")
    rows = mapped(spark, d).withColumn("transfer_uuid", F.when(F.col("seq") % 4 == 0, F.lit("t")))
    rollup.observed_transfers(rows, observation).write.parquet(shared_path(spark, "transfers"))
    got = observation.get
    return spark.createDataFrame([(got["records"], got["transferred"], got["newest"])], "records long, transferred long, newest timestamp_ntz")


@query(
    "j11_backfill",
    f"""WITH {MAPPED}, reg AS (SELECT DISTINCT context, 'old' AS callsignvhf FROM mapped),
    f AS (SELECT context, arg_max(uuid, struct_pack(a := time, b := seq)) AS v FROM mapped WHERE path = 'click' GROUP BY context)
    SELECT context, coalesce(v, callsignvhf) AS callsignvhf FROM reg LEFT JOIN f USING (context)""",
)
def j11(spark, d):
    m = mapped(spark, d)
    registry = m.select("context", F.lit("old").alias("callsignvhf")).distinct()
    return upsert.backfill(registry, m.withColumn("value", F.col("uuid")), "callsignvhf", "click")


@query("s06_scan", f"WITH {MAPPED} SELECT time, connector, type, context, origin, CASE WHEN path IN ('click','view') THEN '' ELSE path END AS path, value, uuid FROM mapped WHERE origin = 'v2' AND value > 50")
def s06(spark, d):
    from ..sources.tables import scan

    return scan(mapped(spark, d), (F.col("origin") == "v2") & (F.col("value") > 50), names=("click", "view")).drop("transfer_uuid")


@query("s07_raw_lookup", f"WITH {MAPPED} SELECT seq, uuid, value FROM mapped WHERE uuid = 'u7'")
def s07(spark, d):
    from ..sources.tables import raw_lookup

    return raw_lookup(mapped(spark, d), "u7").select("seq", "uuid", "value")


@query("s08_union_view", f"WITH {MAPPED} SELECT seq, context, origin FROM mapped")
def s08(spark, d):
    from ..sources.tables import union_view

    m = mapped(spark, d).select("seq", "context", "origin")
    return union_view(m.where("context = origin"), m.where("context <> origin"))


@query("j09_tenant_rows", f"WITH {MAPPED} SELECT seq, origin FROM mapped WHERE origin IN (SELECT 'v' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def j09(spark, d):
    granted = table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("v"), "n_nationkey").alias("origin"))
    return mapped(spark, d).select("seq", "origin").join(granted, "origin", "left_semi")


@query("j12_lineage", f"WITH {MAPPED} SELECT m.seq, m.uuid, o.o_orderstatus AS raw_type FROM mapped m JOIN orders o ON m.uuid = 'u' || o.o_orderkey")
def j12(spark, d):
    raw = table(spark, d, "orders").select(F.concat(F.lit("u"), "o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("raw_type"))
    return mapped(spark, d).select("seq", "uuid").join(raw, "uuid")
