"""Rule expressions that fail on some rows."""

import pytest
from pyspark.sql import functions as F

from brinelake.operators import rules as R
from brinelake.operators.guarded import guarded


@pytest.fixture(scope="module")
def rows(spark):
    schema = "i int, x int, t string, a array<int>, m map<string, int>, s struct<f: int>, path string, msg int"
    data = [
        (0, 0, "abc", [1, None], {"k": 0}, (5,), "p", 0),
        (1, 2, "7", [1, 2, 3], {"k": 4}, (5,), "p", 0),
        (2, None, None, None, None, None, "q", 1),
        (3, 5, "2024-01-31", [], {}, (None,), "p", 2),
    ]
    return spark.createDataFrame(data, schema)


CASES = {
    # expression: (values, rows that fail)
    "1 / x": ([None, 0.5, None, 0.2], {0}),
    "CAST(t AS INT)": ([None, 7, None, None], {0, 3}),
    "t::int + 1": ([None, 8, None, None], {0, 3}),
    "int(t)": ([None, 7, None, None], {0, 3}),
    "x % x": ([None, 0, None, 0], {0}),
    "7 div x": ([None, 3, None, 1], {0}),
    "x + 2147483647": ([2147483647, None, None, None], {1, 3}),
    "-x": ([0, -2, None, -5], set()),
    "a[1]": ([None, 2, None, None], {3}),
    "a[0] + m['k']": ([1, 5, None, None], {3}),
    "element_at(a, 2)": ([None, 2, None, None], {3}),
    "element_at(a, x)": ([None, 2, None, None], {0, 3}),
    "s.f": ([5, 5, None, None], set()),
    "IF(x = 0, 9, 10 / x)": ([9.0, 5.0, None, 2.0], set()),
    "IF(10 / x > 3, 'a', 'b')": ([None, "a", "b", "b"], {0}),
    "CASE x WHEN 0 THEN 1 WHEN 2 THEN 1 / 0 ELSE 3 END": ([1.0, None, 3.0, 3.0], {1}),
    "coalesce(1 / x, 5D)": ([None, 0.5, 5.0, 0.2], {0}),
    "coalesce(x, 1 / 0)": ([0.0, 2.0, None, 5.0], {2}),
    "x > 1 OR 1 / x > 0": ([None, True, None, True], {0}),
    "x > 1 AND 1 / x > 0": ([False, True, None, True], set()),
    "NOT (1 / x > 1)": ([None, True, None, True], {0}),
    "to_timestamp(t) IS NULL": ([None, None, True, False], {0, 1}),
    "raise_error('no')": ([None] * 4, {0, 1, 2, 3}),
    "concat('it''s ', CAST(1 / x AS STRING))": ([None, "it's 0.5", None, "it's 0.2"], {0}),
    "aggregate(transform(a, e -> 1 / (e - 1)), 0D, (p, q) -> p + coalesce(q, 0D))": ([0.0, 1.5, None, 0.0], set()),
    "currentToRatio(20000 / x)": ([None, 0.375, None, 0.0], {0}),
}


@pytest.mark.parametrize("expression", CASES)
def test_values_and_failures(rows, expression):
    g = guarded(rows, expression)
    got = rows.select("i", g.value.alias("v"), g.failed.alias("f")).orderBy("i").collect()
    assert [r.v if not isinstance(r.v, float) else round(r.v, 6) for r in got] == CASES[expression][0]
    assert {r.i for r in got if r.f} == CASES[expression][1]


@pytest.mark.parametrize("expression", ["x +* 1", "nowhere", "no_function(x)", "x + s"])
def test_invalid_expressions_fail_everywhere(rows, expression):
    with pytest.warns(UserWarning):
        g = guarded(rows, expression)
    assert g.kind is None and rows.where(g.failed).count() == 4


def test_other_rules_have_their_results(rows):
    out = R.project(rows, [R.Rule("bad", "1 / x"), R.Rule("good", "x")], "i").collect()
    assert sorted((r.i, r.path, r.value) for r in out) == [(0, "good", "0"), (1, "bad", "0.5"), (1, "good", "2"), (3, "bad", "0.2"), (3, "good", "5")]


def test_filters_reject_whole_messages(rows):
    kept = lambda text, message="msg": sorted(r.i for r in R.drop_where(rows, [R.Rule("p", text)], message).collect())
    assert kept("1 / x > 0.3") == [2, 3]  # row 0 fails and takes row 1 with it
    assert kept("1 / x > 0.3", None) == [2, 3]  # row 1 is dropped
    assert kept("1 / x > 3", None) == [1, 2, 3]
    assert kept("x") == [2]  # a number is neither true nor false
    assert kept("CAST(NULL AS BOOLEAN)") == [2]
    assert kept("x = 5") == [0, 1, 2]


def test_a_failing_source_never_ends_the_job(rows):
    wide = rows.withColumns({f"r{k}": guarded(rows, f"{k} / x + CAST(t AS DOUBLE)").value for k in range(8)})
    assert wide.where(F.col("r3").isNotNull()).count() == 1
