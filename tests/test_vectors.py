"""Fixed vectors: frames, sentences, functions, shapes, filters and combinations."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brinelake.functions import registry as fn
from brinelake.operators import export, flatten, nmea, registers, rules, shapes, signals, spectrum, state, upsert
from brinelake.sources import envelopes

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def mapped(spark, rows):
    """rows: (seconds, path, value) in order of arrival, of one context and connector."""
    data = [(at(t), i, "c", "signalk", "v1", "v1", p, float(v), f"u{i}", None) for i, (t, p, v) in enumerate(rows)]
    return spark.createDataFrame(data, "time timestamp_ntz, seq long, connector string, type string, context string, origin string, path string, value double, uuid string, transfer_uuid string")


def one(df):
    return df.collect()[0]


def test_register_frame_from_base64(spark):
    df = spark.createDataFrame([("AQAEyOwAAgABjnA=",)], "t string").select(F.unbase64("t").alias("value"))
    r = one(registers.decode_header(df))
    assert (r.slave, r.function_code, r.address, r.n, r.words) == (1, 4, 51436, 2, [1, 36464])


@pytest.mark.parametrize("frame", ["", "00052204", "01000200280001"])
def test_short_frames_are_dropped(spark, frame):
    df = spark.createDataFrame([(bytes.fromhex(frame),)], "value binary")
    assert registers.decode_header(df).count() == 0


def test_fuel_rate_rule(spark):
    df = registers.decode_header(spark.createDataFrame([(bytes.fromhex("01000300340001" + "0F92"),)], "value binary"))
    r = one(df.select(((registers.at(52) - 4000) * 0.00000000138888888888888).alias("x")))
    assert r.x == pytest.approx(-1.9444444444444323e-08, rel=1e-12)


def test_two_register_rule(spark):
    df = registers.decode_header(spark.createDataFrame([(bytes.fromhex("01000400160002" + "0F9243EA"),)], "value binary"))
    assert one(df.select((registers.at(22) * 65536 + registers.at(23)).alias("x"))).x == 261243882


@pytest.mark.parametrize("words, wanted", [((0x0F92, 0x0F92), [0x0F92, 0]), ((0x0F92, 0x0FF2, 0x0F92), [0x0F92, 96, -96]), ((0xFFFF, 1), [65535, 1]), ((1, 0xFFFF), [1, -1])])
def test_register_deltas(spark, words, wanted):
    rows = [(at(i), i, "c", 3, 22, w) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, seq long, connector string, slave int, register int, word int")
    got = [(r.delta, r.time_delta) for r in registers.deltas(df).orderBy("seq").collect()]
    assert [d for d, _ in got] == wanted and [t for _, t in got] == [None] + [1000] * (len(words) - 1)


def test_new_address_of_known_slave_starts_from_zero(spark):
    rows = [(at(0), 0, "c", 3, 22, 60000), (at(1), 1, "c", 3, 23, 60000)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, seq long, connector string, slave int, register int, word int")
    assert [r.delta for r in registers.deltas(df).orderBy("seq").collect()] == [60000, 60000 - 65535]


def test_coils_and_words(spark):
    df = spark.createDataFrame([([0xFF00, 0, 0, 0xFF00, 0],)], "words array<int>")
    states = one(df.select(F.transform("words", lambda w: w == registers.ON).alias("s"))).s
    assert states == [True, False, False, True, False]
    assert one(spark.range(1).select(registers.coil_words(F.array(F.lit(True), F.lit(False))).alias("w"))).w == [0xFF00, 0]


def test_sensor_faults(spark):
    rows = [([0x7FFF, 1], True), ([0x8000], True), ([0, 0], True), ([1, 0], False)]
    df = spark.createDataFrame(rows, "words array<int>, bad boolean")
    assert df.where(registers.faulty(F.col("words")) != F.col("bad")).count() == 0


def test_functions(spark):
    v = lambda c: one(spark.range(1).select(c.alias("x"))).x
    assert [v(fn.current_to_ratio(F.lit(float(x)))) for x in (4000, 8000, 12000, 16000, 20000)] == [0, 0.25, 0.5, 0.75, 1]
    assert v(fn.pressure_to_height(F.lit(4810.0), F.lit(840.0))) == pytest.approx(0.5843051506316812)
    assert v(fn.to_float(F.lit(0x3FC0), F.lit(0))) == 1.5 and v(fn.to_float(F.lit(0xC2F6), F.lit(0xE979))) == pytest.approx(-123.456, rel=1e-6)
    assert math.isnan(v(fn.to_float(F.lit(0x7FC0), F.lit(0)))) and v(fn.to_float(F.lit(0x7F80), F.lit(0))) == math.inf
    assert v(fn.to_int32(F.lit(0xFFFF), F.lit(0xFFFE))) == -2 and v(fn.to_int(F.lit(0x8000))) == -32768
    assert v(fn.copy_sign(F.lit(2.0), F.lit(-0.0))) == -2.0 and v(fn.power_w(F.lit(-1.0), F.lit(1.0))) == pytest.approx(2 * math.pi)
    assert v(fn.checksum(F.lit("s:AB0001,n:0"))) == "03" and v(fn.checksum(F.lit("d:XY0002,s:AB0001,c:1644423149,n:42"))) == "3F"


def test_sql_functions(spark):
    fn.register(spark)
    r = one(spark.sql("SELECT currentToRatio(12000) a, toFloat(16320, 0) b, isBitSet(5, 2) c, toInt32(65535, 65534) d, movingAverage(array(1D, 3D)) e, notify(true, 'x') f, bitwiseNot(1) g"))
    assert (r.a, r.b, r.c, r.d, r.e, r.g) == (0.5, 1.5, True, -2, 2.0, 65534) and r.f[0].message == "x"
    assert one(spark.range(1).select(fn.call("toUInt32", F.lit(1), F.lit(2)).alias("x"))).x == 65538


@pytest.mark.parametrize("height, offset, volume", [(0.029, 1.2, 0.0), (2.0, 1.2, 44.0)])
def test_calibration_ends(spark, height, offset, volume):
    from brinelake.plans.decoding import tank

    r = spark.createDataFrame([("t", height, offset)], "tank string, height double, sensor_offset double")
    assert one(signals.volumes(r, tank(spark))).volume == volume


def test_calibration_tables_must_increase(spark):
    t = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 1.0, 2.0), ("b", 0, 1.0, 1.0), ("b", 1, 2.0, 2.0)], "tank string, n int, height double, volume double")
    assert [r.tank for r in signals.invalid_tables(t).collect()] == ["a"]


def test_sentences(spark):
    rows = [("$AIALR,100615.00,002,V,V,AIS: Antenna VSWR exceeds limit*46",), ("$GPGLL,3723.2475,N,12158.3416,W,161229.487,A,A*41",), ("$GPHDT,1,T*00",)]
    out = nmea.mapped_sentences(nmea.sentences(spark.createDataFrame(rows, "value string")), "value").collect()
    by = {r.path: r for r in out}
    assert by["notifications.ais"].flag is False and by["notifications.ais"].text == "AIS: Antenna VSWR exceeds limit"
    assert by["navigation.position.latitude"].number == pytest.approx(37 + 23.2475 / 60)
    assert by["navigation.position.longitude"].number == pytest.approx(-(121 + 58.3416 / 60)) and len(out) == 3


def test_ais_vector(spark):
    df = spark.createDataFrame([("!AIVDM,1,1,,B,33c:72001GPE4S<MdEp4;SM>0141,0*76",)], "value string")
    r = one(nmea.ais_positions(nmea.sentences(df)))
    assert r.context == "vessels.urn:mrn:imo:mmsi:246581000" and r.state == "motoring" and r.rate_of_turn == 0
    assert (r.speed, r.course, r.heading, r.latitude, r.longitude) == pytest.approx((4.475662799999999, 1.8675022996339325, 1.9198621771937625, 51.892, 4.60305), rel=1e-12)


def test_packed_frame(spark):
    df = spark.createDataFrame([(bytes.fromhex("C10204" + "000000" * 5),), (b"short",)], "value binary")
    rows = signals.unpack_channels(df).orderBy("channel").collect()
    assert [r.word for r in rows] == [1057, 0, 0, 0, 0, 0]


def test_can_signal(spark):
    frames = spark.createDataFrame([(0x18FEEE00, bytes([0x58, 0x02, 0, 0]))], "can_id long, payload binary")
    sig = spark.createDataFrame([(0x0CFEEE11, "o", "t", 0, 16, False, False, 0.1, -40.0, -40.0, 200.0)], "can_id long, origin string, name string, start_bit int, size int, big_endian boolean, signed boolean, factor double, offset double, min double, max double")
    rule = spark.createDataFrame([("o", "t", "p")], "origin string, name string, path string")
    assert one(signals.decode_can(frames, sig, rule)).value + 273.15 == pytest.approx(293.15)


def test_combine_and_overwrite(spark):
    rows = [(0, "other", 1), (1, "a", 5.6), (2, "b", 5.6), (3, "a", 7.6), (4, "sum", 0)]
    out = state.combine(mapped(spark, rows), ["a", "b"], F.col("a") + F.col("b"), "sum", overwrite=True)
    got = [(r.time, r.value) for r in out.where("path = 'sum'").orderBy("seq").collect()]
    assert got == [(at(2), 11.2), (at(3), 13.2)] and out.count() == 6


def test_rate_limit(spark):
    m = mapped(spark, [(t, "p", 0) for t in (0, 0.5, 1.0, 1.5, 2.1, 2.6)])
    times = lambda df: [(r.time - T0).total_seconds() for r in df.orderBy("seq").collect()]
    assert times(state.rate_limit(m, 1)) == [0, 1.5, 2.6]
    assert times(state.rate_limit(m, 1, record_first=False)) == [0, 0.5, 2.1]
    assert times(state.rate_limit(m, 100, per_path={"p": 2})) == [0, 2.1]


def test_changes_without_late(spark):
    m = mapped(spark, [(1, "p", 5), (2, "p", 5), (1.5, "p", 7), (2, "p", 8)])
    assert [r.seq for r in state.changes_without_late(m).orderBy("seq").collect()] == [0, 2, 3]


def test_upsert_twice_is_once(spark):
    m = mapped(spark, [(0, "p", 1), (0, "p", 2)]).withColumn("uuid", F.concat(F.lit("u"), "seq"))
    once = upsert.upsert(m.where("seq = 0"), m.where("seq = 1"))
    r = one(once)
    assert (r.uuid, r.value) == ("u0", 2.0)
    old = once.withColumn("seq", F.lit(0).cast("long"))
    assert upsert.upsert(old, m.where("seq = 1")).select("value", "uuid").collect() == once.select("value", "uuid").collect()


def test_flatten_and_rebuild(spark):
    m = mapped(spark, [(0, "a", 1), (1, "b", 2)]).withColumn("value", F.col("value").cast("string"))
    back = flatten.flatten(flatten.rebuild(m)).drop("update_no", "value_no")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.select(back.columns).collect()))
    assert flatten.flatten(flatten.rebuild(m).withColumn("updates", F.slice("updates", 1, 0))).count() == 0


@pytest.mark.parametrize(
    "value, shape",
    [("{}", "position"), ('{"mmsi":"1"}', "vesselInfo"), ('{"id":1}', "vesselType"), ('{"currentPort":[1]}', "draft"), ('[{"state":true,"message":"x"}]', "notifications"), ("1", "integer"), ("1.5", "number"), ('"x"', "text"), ("true", "flag"), ('{"q":1}', None), ("{", None)],
)
def test_shapes(spark, value, shape):
    assert one(spark.createDataFrame([(value,)], "v string").select(shapes.shape_of(F.col("v")).alias("s"))).s == shape


def test_raw_envelope(spark):
    good = '{"connector":"GPS","type":"nmea0183","timestamp":"2022-02-09T12:03:57.431272983Z","uuid":"496aa0fb-d838-4631-a12f-dbad3cb27389","value":"JEdQ"}'
    rows = [(good,), ("nonsense",), ('{"connector":"GPS"}',), (good.replace("JEdQ", ""),)]
    out = envelopes.raw_messages(spark.createDataFrame(rows, "value string")).collect()
    assert bytes(out[0].value) == b"$GP" and out[0].reason is None and bytes(out[3].value) == b""
    assert out[1].reason == "no JSON" and out[2].reason == "timestamp is missing"


def test_csv_fields(spark):
    df = spark.createDataFrame([("TANK:CT-1;1,5;7\nOTHER;1",)], "value string")
    r = rules.csv_fields(df, "value", "TANK:CT-1;", split_lines=True).collect()
    assert len(r) == 1 and r[0].floats == [1.5, 7.0] and r[0].ints == [0, 7]


def test_spectrum_of_a_sine(spark):
    m = mapped(spark, [(i, "p", math.sin(2 * math.pi * i / 8)) for i in range(16)])
    r = one(spectrum.spectra(m, 8, 0.125))
    assert r.duration == 8 and [c.magnitude for c in r.coefficients] == pytest.approx([1, 0, 0, 0], abs=1e-9)
    assert spectrum.spectra(mapped(spark, [(i, "p", 1) for i in range(15)]), 8, 0.125).count() == 0


def test_tag_block(spark):
    v = lambda c: one(spark.range(1).select(c.alias("x"))).x
    assert v(export.tag_block(source="AB0001", line=F.lit(0))) == "\\s:AB0001,n:0*03\\"
    assert v(export.tag_block("XY0002", "AB0001", F.lit(1644423149), F.lit(42))) == "\\d:XY0002,s:AB0001,c:1644423149,n:42*3F\\"


def test_filter_rejects_the_whole_message(spark):
    m = mapped(spark, [(0, "a", 1), (0, "b", 2), (1, "a", 3)]).withColumn("msg", F.expr("seq div 2"))
    rule = rules.Rule("a", "IF(value = 1, NULL, value > 10)")
    assert [r.seq for r in rules.drop_where(m, [rule], "msg").collect()] == [2]
