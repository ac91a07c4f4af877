"""Reconciliation where origins have more incomplete periods than a small table has."""

from brinelake.operators import reconcile as R
from brinelake.plans import all_queries, reconciliation

SF_DIR = "/root/testdata/sf0.01"


def test_newest_periods_are_the_default_number(spark):
    incomplete = R.incomplete(reconciliation.compared(spark, SF_DIR)).groupBy("origin").count().collect()
    want = {r["origin"]: min(r["count"], R.MAX_PERIODS + 1) for r in incomplete}
    assert max(want.values()) > 21
    assert {r["origin"]: r["periods"] for r in all_queries()["a10_missing_stats"](spark, SF_DIR).collect()} == want
    assert all_queries()["w07_newest_periods"](spark, SF_DIR).count() == sum(want.values())
    periods = {(r["origin"], r["start"]) for r in all_queries()["j07_resend_uuids"](spark, SF_DIR).select("origin", "start").collect()}
    assert len(periods) > 21 * len(want)
