"""NMEA 0183 sentences and AIS position reports as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import checksum

KNOT = 0.514444
#: Qualities of a fix (fixed values of the Signal K vocabulary), by the digit of a GGA sentence.
QUALITIES = ("no GPS", "GNSS Fix", "DGNSS fix", "Precise GNSS", "RTK fixed integer", "RTK float", "Estimated (DR) mode", "Manual input", "Simulator mode")
FREEZING = 273.15  # kelvin
#: Navigation states of a position report (fixed values), by code.
STATES = ("motoring", "anchored", "not under command", "restricted manouverability", "constrained by draft", "moored", "aground", "fishing", "sailing")


def sentences(rows: DataFrame, value: str = "value", allow_empty: bool = False, allow_mismatch: bool = False) -> DataFrame:
    """Adds talker, kind, fields and valid; ``value`` is the sentence's text.

    A sentence is valid if its checksum is right, or absent if ``allow_empty``, or wrong if ``allow_mismatch``.
    """
    text = F.rtrim(F.regexp_replace(F.col(value).cast("string"), r"[\r\n]+$", ""))
    body = F.regexp_extract(text, r"^[$!]([^*]*)", 1)
    given = F.regexp_extract(text, r"\*([0-9A-Fa-f]{2})$", 1)
    right = F.when(given == "", F.lit(allow_empty)).otherwise((F.upper(given) == checksum(body)) | F.lit(allow_mismatch))
    fields = F.split(body, ",")
    return rows.withColumns(
        {
            "talker": F.substring(body, 1, 2),
            "kind": F.substring(F.element_at(fields, 1), F.lit(3), F.lit(10)),
            "fields": F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0))),
            "valid": text.rlike(r"^[$!]") & right,
        }
    )


def _field(i: int) -> Column:
    return F.get("fields", F.lit(i))


def degrees(value: Column, side: Column) -> Column:
    """Degrees of a ddmm.mmm or dddmm.mmm text with its side."""
    x = value.try_cast("double")
    whole = F.floor(x / 100)
    return (whole + (x - whole * 100) / 60) * F.when(side.isin("S", "W"), -1.0).otherwise(1.0)


def mapped_sentences(rows: DataFrame, *keep: str) -> DataFrame:
    """One (path, number, text, flag) row for each value of the sentence kinds known here; others give none."""
    number = lambda i: _field(i).try_cast("double")
    cell = lambda path, n=None, t=None, b=None: F.struct(
        F.lit(path).alias("path"),
        (F.lit(None) if n is None else n).cast("double").alias("number"),
        (F.lit(None) if t is None else t).cast("string").alias("text"),
        (F.lit(None) if b is None else b).cast("boolean").alias("flag"),
    )
    quality = cell("navigation.gnss.methodQuality", None, F.get(F.array(*map(F.lit, QUALITIES)), _field(5).try_cast("int")))
    # a rudder's angle counts if its status is A
    starboard, port = F.when(_field(1) == "A", number(0)), F.when(_field(3) == "A", number(2))
    date = F.concat_ws("-", _field(3), F.lpad(_field(2), 2, "0"), F.lpad(_field(1), 2, "0"))
    clock = F.regexp_replace(_field(0), r"^(\d\d)(\d\d)(\d\d)", "$1:$2:$3")
    moment = F.concat(date, F.lit(" "), clock).try_cast("timestamp_ntz")
    lat, lon = "navigation.position.latitude", "navigation.position.longitude"
    by_kind = {
        "GLL": [cell(lat, degrees(_field(0), _field(1))), cell(lon, degrees(_field(2), _field(3)))],
        "GGA": [cell(lat, degrees(_field(1), _field(2))), cell(lon, degrees(_field(3), _field(4))), cell("navigation.position.altitude", number(8)), quality, cell("navigation.gnss.satellites", number(6))],
        "RMC": [
            cell(lat, degrees(_field(2), _field(3))),
            cell(lon, degrees(_field(4), _field(5))),
            cell("navigation.speedOverGround", number(6) * KNOT),
            cell("navigation.courseOverGroundTrue", F.radians(number(7))),
        ],
        "VTG": [cell("navigation.courseOverGroundTrue", F.radians(number(0))), cell("navigation.speedOverGround", number(4) * KNOT)],
        "HDT": [cell("navigation.headingTrue", F.radians(number(0)))],
        "ROT": [cell("navigation.rateOfTurn", F.radians(number(0)) / 60)],
        "DBT": [cell("environment.depth.belowTransducer", number(2))],
        # an offset above zero is the transducer's depth
        "DPT": [cell("environment.depth.belowTransducer", number(0)), cell("environment.depth.belowSurface", F.when(number(1) > 0, number(0) + number(1)))],
        "DBS": [cell("environment.depth.belowSurface", number(2))],
        "HDM": [cell("navigation.headingMagnetic", F.radians(number(0)))],
        "HDG": [cell("navigation.headingMagnetic", F.radians(number(0)))],
        "MTW": [cell("environment.water.temperature", number(0) + FREEZING)],
        "MWD": [
            cell("environment.wind.directionTrue", F.radians(number(0))),
            cell("environment.wind.directionMagnetic", F.radians(number(2))),
            cell("environment.wind.speedOverGround", F.coalesce(number(6), number(4) * KNOT)),
        ],
        "MDA": [
            cell("environment.outside.temperature", number(4) + FREEZING),
            cell("environment.water.temperature", number(6) + FREEZING),
            cell("environment.outside.humidity", number(8) / 100),
            cell("environment.outside.dewPointTemperature", number(10) + FREEZING),
            cell("environment.wind.directionTrue", F.radians(number(12))),
            cell("environment.wind.directionMagnetic", F.radians(number(14))),
            cell("environment.wind.speedOverGround", F.coalesce(number(18), number(16) * KNOT)),
        ],
        "RSA": [cell("steering.rudderAngle", F.radians(F.coalesce((starboard + port) / 2, starboard, port)))],
        "ZDA": [cell("navigation.datetime", None, F.when(moment.isNotNull(), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))],
        "MWV": [
            cell("environment.wind.angleApparent", F.when(_field(1) == "R", F.radians(number(0)))),
            cell("environment.wind.speedApparent", F.when(_field(1) == "R", number(2) * F.when(_field(3) == "N", KNOT).when(_field(3) == "K", 1 / 3.6).otherwise(1.0))),
        ],
        "VHW": [cell("navigation.headingTrue", F.radians(number(0))), cell("navigation.speedThroughWater", number(4) * KNOT)],
        "ALR": [cell("notifications.ais", None, _field(4), _field(2) == "A")],
    }
    none = F.array().cast("array<struct<path: string, number: double, text: string, flag: boolean>>")
    cells = none
    for kind, own in by_kind.items():
        cells = F.when(F.col("kind") == kind, F.array(*own)).otherwise(cells)
    out = rows.where("valid").select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")
    return out.where("number is not null or text is not null or flag is not null")


def whole_messages(rows: DataFrame) -> DataFrame:
    """AIS sentences but those with more fragments to come."""
    return rows.where(_field(0) == _field(1))


def ais_positions(rows: DataFrame, *keep: str) -> DataFrame:
    """Position reports of one fragment: context, mmsi, rate_of_turn, speed, course, heading, state, latitude, longitude.

    The payload's characters hold six bits each.  Values that mean "not available" are null.
    """
    some = whole_messages(rows.where(F.col("valid") & F.col("kind").isin("VDM", "VDO") & (_field(0) == "1")))
    out = some.withColumn("__payload", _field(4)).where(F.length("__payload") * 6 >= 137)

    def six(i: int) -> Column:
        code = F.ascii(F.substring("__payload", i + 1, 1)) - 48
        return (code - F.when(code > 40, 8).otherwise(0)).bitwiseAND(63).cast("long")

    def unsigned(at: int, n: int) -> Column:
        """The ``n`` bits from ``at``, by shifts of the characters that hold them: no text of bits is ever made."""
        first, last = at // 6, (at + n - 1) // 6
        whole = functools.reduce(lambda x, i: F.shiftleft(x, 6).bitwiseOR(six(i)), range(first + 1, last + 1), six(first))
        return F.shiftright(whole, 6 * (last + 1) - at - n).bitwiseAND((1 << n) - 1)

    signed = lambda at, n: unsigned(at, n) - F.when(unsigned(at, 1) == 1, 1 << n).otherwise(0)
    kind, mmsi = unsigned(0, 6), unsigned(8, 30)
    turn, sog, lon, lat, cog, head = signed(42, 8), unsigned(50, 10), signed(61, 28), signed(89, 27), unsigned(116, 12), unsigned(128, 9)
    states = F.get(F.array(*map(F.lit, STATES)), unsigned(38, 4).cast("int"))
    rate = F.when(turn == -128, None).otherwise(F.signum(turn.cast("double")) * F.pow(turn / 4.733, 2) * F.radians(F.lit(1.0)) / 60)
    return out.where(kind.isin(1, 2, 3)).select(
        *keep,
        F.concat(F.lit("vessels.urn:mrn:imo:mmsi:"), F.lpad(mmsi.cast("string"), 9, "0")).alias("context"),
        F.lpad(mmsi.cast("string"), 9, "0").alias("mmsi"),
        rate.alias("rate_of_turn"),
        F.when(sog != 1023, sog / 10 * KNOT).alias("speed"),
        F.when(cog < 3600, F.radians(cog / 10)).alias("course"),
        F.when(head < 360, F.radians(head.cast("double"))).alias("heading"),
        states.alias("state"),
        F.when(F.abs(lat) <= 54_000_000, lat / 600000).alias("latitude"),
        F.when(F.abs(lon) <= 108_000_000, lon / 600000).alias("longitude"),
    )
