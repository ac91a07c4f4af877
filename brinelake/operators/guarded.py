"""Rule expressions whose failing operations end the rule for that row, not the job.

Spark's SQL raises an error where a division has a zero, a cast a text that isn't a number, or an index no element.  A rule's
text is parsed by Spark, and each operation that can fail is replaced by its ``try`` form; beside the value there
is a flag that is true where an operation that is reached fails.  The flag follows evaluation: a branch that isn't taken, the
right side of ``and`` and ``or`` that isn't needed, and what stands after the first value of ``coalesce`` can't fail, and
a failure inside stays one, whatever is done with the null it leaves.  Both are ordinary column expressions.

Inside lambdas failing operations give null and set no flag.  Overflow of whole numbers is a failure.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import SQL_BODIES, inlined

#: Operators and functions that raise errors, and their forms that give null instead.
TRY_FORMS = {
    "Add": "try_add",
    "Subtract": "try_subtract",
    "Multiply": "try_multiply",
    "Divide": "try_divide",
    "Remainder": "try_mod",
    "mod": "try_mod",
    "to_timestamp": "try_to_timestamp",
    "to_date": "try_to_date",
    "to_time": "try_to_time",
    "to_number": "try_to_number",
    "to_binary": "try_to_binary",
    "parse_json": "try_parse_json",
    "variant_get": "try_variant_get",
    "url_decode": "try_url_decode",
    "parse_url": "try_parse_url",
    "make_timestamp": "try_make_timestamp",
    "make_interval": "try_make_interval",
}
#: Functions that are casts.
CASTS = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "binary")


@dataclass
class Guarded:
    """``value`` (null where it failed), ``failed`` (never null), and the type of the value, None if the rule isn't valid at all."""

    value: Column
    failed: Column
    kind: T.DataType | None


@dataclass
class _Part:
    """SQL text of a value, and of the flag if anything in it can fail."""

    value: str
    failed: str | None = None


def _any(*flags: str | None) -> str | None:
    given = [f for f in flags if f]
    return "(" + " OR ".join(given) + ")" if given else None


def _when(condition: str, flag: str | None) -> str | None:
    return f"({condition} AND {flag})" if flag else None


def _null_of(value: str, *inputs: str) -> str:
    """A null that no input explains."""
    return "(" + " AND ".join([f"{value} IS NULL", *(f"{x} IS NOT NULL" for x in inputs)]) + ")"


class _Rewriter:
    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        self.rows, self.parser = rows, spark._jsparkSession.sessionState().sqlParser()
        self.sequence = spark._jvm.scala.jdk.javaapi.CollectionConverters.asScala
        self.list = spark._jvm.java.util.ArrayList

    def text(self, expression: str) -> _Part:
        return self.part(self.parser.parseExpression(expression))

    def part(self, e) -> _Part:
        kind = e.getClass().getSimpleName()
        if kind == "LambdaFunction":
            body, *names = self._children(e)
            given = ", ".join(n.sql() for n in names)
            return _Part(f"{given if len(names) == 1 else f'({given})'} -> {self.part(body).value}")
        parts = [self.part(c) for c in self._children(e)]
        if kind == "UnresolvedFunction":
            return self.function(e.nameParts().mkString("."), parts)
        if kind == "CaseWhen":
            return self.case(parts)
        if kind in ("And", "Or"):
            left, right = parts
            needed = f"coalesce({left.value}, true)" if kind == "And" else f"NOT coalesce({left.value}, false)"
            return _Part(f"({left.value} {kind.upper()} {right.value})", _any(left.failed, _when(needed, right.failed)))
        if kind in TRY_FORMS:
            return self.failing(f"{TRY_FORMS[kind]}({parts[0].value}, {parts[1].value})", parts)
        if kind == "IntegralDivide":
            a, b = (p.value for p in parts)
            return self.failing(f"({a} div nullif({b}, 0))", parts)
        if kind == "UnaryMinus":
            return self.failing(f"try_subtract(0, {parts[0].value})", parts)
        if kind == "Cast":
            return self.failing(f"try_cast({parts[0].value} AS {e.dataType().sql()})", parts)
        if kind == "UnresolvedExtractValue":
            return self.element(parts, e.sql(), lambda array, i: f"get({array}, {i})", lambda array, i: f"({i} < 0 OR {i} >= size({array}))")
        if not parts:
            return _Part(e.sql())
        new = self.list()
        for p in parts:
            new.add(self.parser.parseExpression(p.value))
        return _Part(e.withNewChildren(self.sequence(new).toSeq()).sql(), _any(*(p.failed for p in parts)))

    @staticmethod
    def _children(e) -> list:
        found = e.children()
        return [found.apply(k) for k in range(found.size())]

    @staticmethod
    def failing(value: str, parts: list[_Part]) -> _Part:
        return _Part(value, _any(*(p.failed for p in parts), _null_of(value, *(p.value for p in parts))))

    def element(self, parts: list[_Part], plain: str, found: Callable, outside: Callable) -> _Part:
        """An element of an array may be missing; fields and keys of other types give null."""
        of, i = (p.value for p in parts)
        below = _any(*(p.failed for p in parts))
        if not isinstance(self.rows.select(F.expr(of)).schema[0].dataType, T.ArrayType):
            return _Part(plain, below)
        return _Part(found(of, i), _any(below, f"coalesce({outside(of, i)}, false)"))

    def function(self, name: str, parts: list[_Part]) -> _Part:
        values, low = [p.value for p in parts], name.lower()
        called = f"{name}({', '.join(values)})"
        below = _any(*(p.failed for p in parts))
        if name in SQL_BODIES:  # a named function of rules is its body
            inner = self.text(inlined(name, *values))
            return _Part(inner.value, _any(below, inner.failed))
        if low in ("if", "iff"):
            return self.case(parts)
        if low in ("coalesce", "nvl", "ifnull"):
            flags = [parts[0].failed, *(_when(" AND ".join(f"{v} IS NULL" for v in values[:k]), parts[k].failed) for k in range(1, len(parts)))]
            return _Part(called, _any(*flags))
        if low == "nvl2":
            return _Part(called, _any(parts[0].failed, _when(f"{values[0]} IS NOT NULL", parts[1].failed), _when(f"{values[0]} IS NULL", parts[2].failed)))
        if low in CASTS:
            return self.failing(f"try_cast({values[0]} AS {low.upper()})", parts)
        if low == "raise_error":
            return _Part("NULL", "true")
        if low == "assert_true":
            return _Part("NULL", _any(below, f"NOT coalesce({values[0]}, false)"))
        if low == "element_at":
            return self.element(parts, called, lambda array, i: f"try_element_at({array}, nullif({i}, 0))", lambda array, i: f"({i} = 0 OR abs({i}) > size({array}))")
        if low in TRY_FORMS:
            return self.failing(f"{TRY_FORMS[low]}({', '.join(values)})", parts)
        return _Part(called, below)

    @staticmethod
    def case(parts: list[_Part]) -> _Part:
        """Conditions and results in turns, and what else holds."""
        text, flags, before = "CASE", [], []
        for condition, result in zip(parts[::2], parts[1::2]):
            reached = " AND ".join(before) or "true"
            taken = f"coalesce({condition.value}, false)"
            flags += [_when(reached, condition.failed), _when(f"{reached} AND {taken}", result.failed)]
            before.append(f"NOT {taken}")
            text += f" WHEN {condition.value} THEN {result.value}"
        if len(parts) % 2:
            flags.append(_when(" AND ".join(before), parts[-1].failed))
            text += f" ELSE {parts[-1].value}"
        return _Part(f"({text} END)", _any(*flags))


def guarded(rows: DataFrame, expression: str) -> Guarded:
    """The expression over ``rows``.  One that Spark can't parse or resolve fails on every row, with a warning."""
    try:
        part = _Rewriter(rows).text(expression)
        failed = F.expr(f"coalesce({part.failed}, false)") if part.failed else F.lit(False)
        value = F.when(~failed, F.expr(part.value))
        kind = rows.select(value).schema[0].dataType
    except (AnalysisException, ParseException) as e:
        warnings.warn(f"the rule expression {expression!r} isn't valid: {str(e).splitlines()[0]}", stacklevel=2)
        return Guarded(F.lit(None), F.lit(True), None)
    return Guarded(value, failed, kind)
