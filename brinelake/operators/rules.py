"""Mapping rules compiled to column expressions: projection, filters, time override, dispatch, quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .guarded import guarded


@dataclass
class Rule:
    """One rule: a path and a Spark SQL expression over the row, which may use the constants."""

    path: str
    expression: str
    timestamp: str | None = None
    constants: dict[str, object] = field(default_factory=dict)
    source_paths: tuple[str, ...] = ()
    overwrite: bool = False


def rule_text(rule: Rule, expression: str | None = None) -> str:
    """The expression with the rule's constants in place of their names; a constant hides a column of its name."""
    import re

    text = expression or rule.expression
    for name, value in rule.constants.items():
        literal = "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else str(value)
        text = re.sub(rf"(?<![\w.'\"]){re.escape(name)}(?![\w('\"])", literal.replace("\\", r"\\"), text)
    return text


def project(rows: DataFrame, rules: Sequence[Rule], *keep: str) -> DataFrame:
    """One row (keep, path, value) for each rule that has a result; values are doubles or texts by ``kind``.

    A rule whose expression fails on a row has no result there, and the others have theirs.  All rules are evaluated in one
    pass over the row, without a join.
    """
    cells = [F.struct(F.lit(r.path).alias("path"), guarded(rows, rule_text(r)).value.cast("string").alias("value")) for r in rules]
    return rows.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.path", "c.value").where("value is not null")


def time_override(time: Column, texts: Sequence[Column], max_age_days: int = 365) -> Column:
    """The time of the last text that is a time less than ``max_age_days`` before ``time``, else ``time``."""
    out = time
    for text in texts:
        t = F.try_to_timestamp(text).cast("timestamp_ntz")
        out = F.when(t.isNotNull() & (t > time - F.expr(f"INTERVAL {max_age_days} DAYS")), t).otherwise(out)
    return out


def drop_where(rows: DataFrame, rules: Sequence[Rule], message: str | None = None) -> DataFrame:
    """Rows for which no rule of their path is true.

    A rule that fails, or whose result isn't true or false, rejects the row's whole ``message`` (the row alone without one).
    """
    drop, failed = F.lit(False), F.lit(False)
    for r in rules:
        here = F.col("path").isin(list(r.source_paths) or [r.path])
        g = guarded(rows, rule_text(r))
        if isinstance(g.kind, BooleanType):
            drop = drop | (here & F.coalesce(g.value, F.lit(False)))
            failed = failed | (here & g.value.isNull())
        else:
            failed = failed | here
    if message is None:
        return rows.where(~drop & ~failed)
    bad = rows.where(failed).select(message).distinct()
    return rows.join(bad, message, "left_anti").where(~drop)


def dispatch(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with each rule that lists their path; ``rules`` (rule_id, source_paths) is configuration."""
    by_path = rules.select("rule_id", F.explode("source_paths").alias("path"))
    return rows.join(by_path, "path")


def json_payload(rows: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``json``, the payload as a variant; rows that hold no JSON object go."""
    text = F.col(value).cast("string")
    return rows.withColumn("json", F.try_parse_json(text)).where(F.col("json").isNotNull() & text.startswith("{"))


def csv_fields(
    rows: DataFrame, value: str, prefix: str = "", separator: str = ";", split_lines: bool = False, pattern: str | None = None, replacement: str = ""
) -> DataFrame:
    """Adds strings, floats and ints, the fields after ``prefix``; lines without it go, and what isn't a number is 0.

    A float that doesn't parse is tried with points and commas swapped.
    """
    line = F.col(value).cast("string")
    if split_lines:
        rows = rows.withColumn("__line", F.explode(F.split(line, r"\r?\n")))
        line = F.col("__line")
    import re

    out = rows.where(line.startswith(prefix)).withColumn("strings", F.split(F.substring(line, F.lit(len(prefix) + 1), F.length(line)), re.escape(separator)))
    if pattern is not None:
        out = out.withColumn("strings", F.transform("strings", lambda s: F.regexp_replace(s, pattern, replacement)))
    number = lambda s: F.coalesce(s.try_cast("double"), F.translate(s, ".,", ",.").try_cast("double"), F.lit(0.0))
    out = out.withColumn("floats", F.transform("strings", number))
    out = out.withColumn("ints", F.transform("strings", lambda s: F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint")).otherwise(F.lit(None)))).withColumn(
        "ints", F.transform("ints", lambda i: F.coalesce(i, F.lit(0).cast("bigint")))
    )
    return out.drop("__line")


def byte_at(value: Column, i: int) -> Column:
    """Byte ``i`` (from 0) of a binary column as an integer, null past its end."""
    return F.when(F.length(value) > i, F.conv(F.hex(F.substring(value, i + 1, 1)), 16, 10).cast("int"))


def quarantine(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one and the reason)."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
