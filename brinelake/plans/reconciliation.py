"""Two-site reconciliation: remote has all rows, local lacks every tenth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..operators import rollup
from .feeds import MAPPED, mapped
from .registry import query

BUCKET = "time_bucket(INTERVAL 5 MINUTE, time)"
SITES = f"""WITH {MAPPED},
  remote AS (SELECT {BUCKET} AS start, origin, count(*) AS count FROM mapped GROUP BY ALL),
  local AS (SELECT {BUCKET} AS start, origin, count(*) AS count FROM mapped WHERE seq % 10 <> 0 GROUP BY ALL),
  both_sites AS (SELECT r.origin, r.start, coalesce(l.count, 0) AS local_count, r.count AS remote_count
    FROM local l RIGHT JOIN remote r ON l.start = r.start AND l.origin = r.origin
    WHERE r.start BETWEEN (SELECT min(start) FROM local) AND (SELECT max(start) FROM local)),
  incomplete AS (SELECT * FROM both_sites WHERE local_count < remote_count * 0.99),
  newest AS (SELECT * FROM incomplete QUALIFY row_number() OVER (PARTITION BY origin ORDER BY start DESC) <= 501)"""
PER_UUID = f"""{SITES},
  have AS (SELECT p.origin, p.start, m.uuid, count(*) AS count FROM newest p JOIN mapped m ON m.origin = p.origin
    AND m.time BETWEEN p.start AND p.start + INTERVAL 5 MINUTE WHERE m.seq % 10 <> 0 GROUP BY ALL),
  there AS (SELECT p.origin, p.start, m.uuid, count(*) AS count FROM newest p JOIN mapped m ON m.origin = p.origin
    AND m.time BETWEEN p.start AND p.start + INTERVAL 5 MINUTE GROUP BY ALL),
  resend AS (SELECT t.* FROM there t WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.origin = t.origin AND h.start = t.start
    AND h.uuid = t.uuid AND t.count <= h.count))"""


def sites(spark, d):
    m = mapped(spark, d)
    return m.where("seq % 10 <> 0"), m


def compared(spark, d):
    local, remote = sites(spark, d)
    return R.compare_counts(rollup.period_counts(local), rollup.period_counts(remote))


@query("j04_compare_counts", f"{SITES} SELECT * FROM both_sites")
def j04(spark, d):
    return compared(spark, d)


@query("j05_compare_by_parts", f"{SITES} SELECT * FROM both_sites")
def j05(spark, d):
    local, remote = sites(spark, d)
    return R.compare_counts_by_parts(rollup.period_counts(local), rollup.period_counts(remote))


@query(
    "j06_count_requests",
    f"""{SITES}, now_at AS (SELECT max(time) + INTERVAL 1 HOUR AS last FROM mapped),
    series AS (SELECT origin, unnest(generate_series(f, (SELECT last FROM now_at), INTERVAL 5 MINUTE)) AS start
      FROM (SELECT origin, min(start) AS f FROM local GROUP BY origin))
    SELECT origin, start FROM series s WHERE start < (SELECT last FROM now_at)
      AND NOT EXISTS (SELECT 1 FROM remote r WHERE r.origin = s.origin AND r.start = s.start)""",
)
def j06(spark, d):
    local, remote = sites(spark, d)
    asof = remote.agg(F.max("time")).scalar() + F.expr("INTERVAL 2 HOURS")
    return R.count_requests(rollup.period_counts(local), rollup.period_counts(remote), asof)


@query("f13_incomplete", f"{SITES} SELECT * FROM incomplete ORDER BY start DESC")
def f13(spark, d):
    return R.incomplete(compared(spark, d)).orderBy(F.desc("start"))


@query("w07_newest_periods", f"{SITES} SELECT * FROM newest")
def w07(spark, d):
    return R.newest_periods(R.incomplete(compared(spark, d)))


@query("a10_missing_stats", f"{SITES} SELECT origin, count(*) AS periods, max(start) AS newest, min(start) AS oldest FROM newest GROUP BY origin")
def a10(spark, d):
    return R.missing_stats(R.newest_periods(R.incomplete(compared(spark, d))))


@query("a11_completeness", f"{SITES} SELECT *, local_count / remote_count AS ratio FROM both_sites")
def a11(spark, d):
    return R.completeness(compared(spark, d))


def resend(spark, d):
    local, remote = sites(spark, d)
    periods = R.newest_periods(R.incomplete(compared(spark, d)))
    return R.resend_uuids(rollup.rows_per_uuid(remote, periods), rollup.rows_per_uuid(local, periods)), remote


@query("j07_resend_uuids", f"{PER_UUID} SELECT * FROM resend")
def j07(spark, d):
    return resend(spark, d)[0]


@query(
    "j08_resend_rows",
    f"""{PER_UUID} SELECT DISTINCT m.seq, m.uuid, 'resend' AS transfer_uuid FROM mapped m JOIN resend r ON m.origin = r.origin
    AND m.uuid = r.uuid AND m.time BETWEEN r.start AND r.start + INTERVAL 5 MINUTE""",
)
def j08(spark, d):
    uuids, remote = resend(spark, d)
    return R.resend_rows(remote, uuids, F.lit("resend")).select("seq", "uuid", "transfer_uuid")


@query(
    "x03_difference",
    f"{SITES} SELECT start, origin FROM remote r WHERE NOT EXISTS (SELECT 1 FROM local l WHERE l.start = r.start AND l.origin = r.origin)",
)
def x03(spark, d):
    local, remote = sites(spark, d)
    return rollup.period_counts(remote).join(rollup.period_counts(local), ["start", "origin"], "left_anti").select("start", "origin")
