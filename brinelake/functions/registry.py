"""Named functions of mapping rules, as column expressions.

``register(spark)`` also creates them as SQL functions, so that rule text can call them; their bodies are
SQL expressions, which Catalyst inlines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAVITY = 9.8  # the value that results are defined with

#: name -> (parameters, SQL body, result type)
SQL_BODIES = {
    "currentToRatio": ("x DOUBLE", "(x - 4000) / 16000", "DOUBLE"),
    "pressureToHeight": ("p DOUBLE, density DOUBLE", f"p / (density * {GRAVITY}D)", "DOUBLE"),
    "heightToVolume": (
        # heights and volumes rise strictly, or the result is null
        "height DOUBLE, sensorOffset DOUBLE, heights ARRAY<DOUBLE>, volumes ARRAY<DOUBLE>",
        "CASE WHEN size(heights) <> size(volumes) THEN NULL WHEN size(heights) = 0 THEN 0D "
        "WHEN exists(slice(sequence(1, size(heights)), 2, size(heights)), i -> NOT (element_at(heights, i - 1) < element_at(heights, i) AND element_at(volumes, i - 1) < element_at(volumes, i))) THEN NULL "
        "ELSE aggregate(sequence(1, size(heights)), 0D, (v, i) -> CASE WHEN height + sensorOffset < element_at(heights, i) THEN v WHEN i = size(heights) THEN element_at(volumes, i) "
        "ELSE element_at(volumes, i) + least(1D, (height + sensorOffset - element_at(heights, i)) / (element_at(heights, i + 1) - element_at(heights, i))) * (element_at(volumes, i + 1) - element_at(volumes, i)) END) END",
        "DOUBLE",
    ),
    "powerW": ("r DOUBLE, t DOUBLE", "abs(2 * pi() * r * t)", "DOUBLE"),
    "copySign": ("f DOUBLE, s DOUBLE", "abs(f) * IF(s < 0 OR (s = 0 AND startswith(CAST(s AS STRING), '-')), -1, 1)", "DOUBLE"),
    "toUInt": ("hi INT, lo INT", "hi * 256 + lo", "INT"),
    "toInt": ("x INT", "IF(x >= 32768, x - 65536, x)", "INT"),
    "toUInt32": ("hi BIGINT, lo BIGINT", "hi * 65536 + lo", "BIGINT"),
    "toInt32": ("hi BIGINT, lo BIGINT", "IF(hi >= 32768, hi * 65536 + lo - 4294967296, hi * 65536 + lo)", "BIGINT"),
    "toFloat": (
        "hi BIGINT, lo BIGINT",
        # sign, exponent and mantissa of an IEEE-754 single
        "CAST(IF(hi >= 32768, -1, 1) * CASE "
        "WHEN (hi div 128) % 256 = 255 THEN IF((hi % 128) * 65536 + lo = 0, double('Infinity'), double('NaN')) "
        "WHEN (hi div 128) % 256 = 0 THEN ((hi % 128) * 65536 + lo) * pow(2D, -149) "
        "ELSE (8388608 + (hi % 128) * 65536 + lo) * pow(2D, (hi div 128) % 256 - 150) END AS DOUBLE)",
        "DOUBLE",
    ),
    "bitwiseAnd": ("x INT, y INT", "x & y", "INT"),
    "bitwiseOr": ("x INT, y INT", "x | y", "INT"),
    "bitwiseXor": ("x INT, y INT", "x ^ y", "INT"),
    "bitwiseNot": ("x INT", "~x & 65535", "INT"),
    "bitwiseContains": ("x INT, p INT", "(x & p) = p", "BOOLEAN"),
    "isBitSet": ("x INT, i INT", "getbit(x, i) = 1", "BOOLEAN"),
    "movingAverage": ("v ARRAY<DOUBLE>", "aggregate(v, 0D, (a, x) -> a + x) / size(v)", "DOUBLE"),
    "notify": ("state BOOLEAN, message STRING", "array(named_struct('state', state, 'message', message))", "ARRAY<STRUCT<state: BOOLEAN, message: STRING>>"),
}


def register(spark: SparkSession) -> None:
    """Create all of them as temporary SQL functions of the session."""
    for name, (parameters, body, kind) in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def inlined(name: str, *args: str) -> str:
    """The SQL text of a named function over texts of arguments."""
    import re

    parameters, body, kind = SQL_BODIES[name]
    given = {}
    for p, text in zip((x.split(" ", 1) for x in parameters.split(", ")), args, strict=True):
        given[p[0]] = f"CAST(({text}) AS {p[1]})"
    # all at once, so that a parameter's name inside an argument stays
    names = "|".join(sorted(given, key=len, reverse=True))
    out = re.sub(rf"(?<![\w'$])({names})(?![\w'(])", lambda m: given[m[1]], body)
    return f"CAST({out} AS {kind})"


def call(name: str, *args: Column | str) -> Column:
    """The expression of a named function over columns, without registering anything."""
    return F.expr(inlined(name, *[a if isinstance(a, str) else a._jc.toString() for a in args]))


def current_to_ratio(x: Column) -> Column:
    return (x - 4000) / 16000


def pressure_to_height(p: Column, density: Column) -> Column:
    return p / (density * GRAVITY)


def power_w(r: Column, t: Column) -> Column:
    """Never negative."""
    return F.abs(2 * F.pi() * r * t)


def copy_sign(f: Column, s: Column) -> Column:
    """|f| with the sign of s; the sign of a negative zero counts."""
    negative = (s < 0) | ((s == 0) & s.cast("string").startswith("-"))
    return F.abs(f) * F.when(negative, -1.0).otherwise(1.0)


def to_uint32(hi: Column, lo: Column) -> Column:
    return hi.cast("long") * 65536 + lo


def to_int32(hi: Column, lo: Column) -> Column:
    x = to_uint32(hi, lo)
    return F.when(hi >= 32768, x - (1 << 32)).otherwise(x)


def to_int(x: Column) -> Column:
    return F.when(x >= 32768, x - 65536).otherwise(x)


def to_float(hi: Column, lo: Column) -> Column:
    """IEEE-754 single from two 16-bit words, as a double."""
    hi, lo = hi.cast("long"), lo.cast("long")
    exponent = F.shiftright(hi, 7).bitwiseAND(255)
    mantissa = hi.bitwiseAND(127) * 65536 + lo
    sign = F.when(hi >= 32768, -1.0).otherwise(1.0)
    special = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    small = mantissa * F.lit(2.0**-149)
    normal = (mantissa + 8388608) * F.pow(F.lit(2.0), exponent - 150)
    return sign * F.when(exponent == 255, special).when(exponent == 0, small).otherwise(normal)


def bit_not(x: Column) -> Column:
    return F.bitwise_not(x).bitwiseAND(65535)


def contains_bits(x: Column, p: Column) -> Column:
    return x.bitwiseAND(p) == p


def pgn(can_id: Column) -> Column:
    """Parameter group of an extended frame id."""
    return can_id.bitwiseAND(67108608)


def swap_marks(x: Column) -> Column:
    return F.translate(x, ".,", ",.")


def checksum(text: Column) -> Column:
    """Exclusive-or of all characters, as two upper-case hex digits."""
    x = F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.when(c == "", 0).otherwise(F.ascii(c))))
    return F.lpad(F.hex(x), 2, "0")


def to_floats(values: Column) -> Column:
    """Numbers of an array of texts; anything else is null."""
    return F.transform(values, lambda v: v.try_cast("double"))


def moving_average(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def parse_time(text: Column) -> Column:
    """RFC 3339 text as a timestamp; null if it isn't one. Digits past six are cut."""
    return F.try_to_timestamp(text)


def format_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def invalid(df: DataFrame, needed: list[str]) -> Column:
    """Reason why a row can't be used: the first of ``needed`` that is null, else null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in needed if c in df.columns], F.lit(None).cast("string"))
