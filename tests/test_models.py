"""Trees of the data model, folds inside updates, merged shapes, routing."""

import datetime
import json

import pytest

from brinelake.operators import export, flatten, latest, state

T0 = datetime.datetime(2024, 1, 1)
LEAVES = [
    ("vessels.urn:a.b", "nav", "1"),
    ("vessels.urn:a.b", "nav.pos", '{"lat":1.5}'),
    ("vessels.urn:a.b", "nav.pos.deep.er", '"x"'),
    ("vessels.urn:a.b", 'say "hi".q\\', "not json"),
    ("vessels.urn:a.b", "", '{"mmsi":"5"}'),
    ("vessels.urn:a.b", "", '{"name":"N"}'),
    ("vessels.urn:a.b", "nav.value.z", "9"),  # below a field of a leaf
    ("vessels.urn:a.b", "name.first", "9"),  # below the name
    ("vessels.urn:a.b", "nav", "2"),
    ("solo", "a.b", "3"),
    ("vessels.c", "x.y", "null"),
    ("vessels.c", "z", None),
    ("vessels.d", "", '{"name":"only"}'),
    ("vessels.e", "", '{"other":1}'),
]


@pytest.fixture(scope="module")
def mapped(spark):
    rows = [(c, p, v, k, T0 + datetime.timedelta(seconds=k), "c0", "t", f"u{k}") for k, (c, p, v) in enumerate(LEAVES)]
    return spark.createDataFrame(rows, "context string, path string, value string, seq long, time timestamp_ntz, connector string, type string, uuid string")


def leaf(k, value, **below):
    return {"value": value, "timestamp": f"2024-01-01T00:00:{k:02d}.000000Z", "source": {"label": "c0", "type": "t", "uuid": f"u{k}"}, **below}


MODEL = {
    "vessels.urn:a.b": {
        "mmsi": "5",
        "name": "N",
        "nav": leaf(8, 2, pos=leaf(1, {"lat": 1.5}, deep={"er": leaf(2, "x")})),
        'say "hi"': {"q\\": leaf(3, "not json")},
    },
    "solo": {"a": {"b": leaf(9, 3)}},
    "vessels.c": {"x": {"y": leaf(10, None)}, "z": leaf(11, None)},
    "vessels.d": {"name": "only"},
}


def test_model_tree(mapped):
    rows = latest.model_tree(mapped).collect()
    assert {r.context: json.loads(r.document) for r in rows} == MODEL
    assert {(r.root, r.name) for r in rows} == {("vessels", "urn:a.b"), ("solo", None), ("vessels", "c"), ("vessels", "d")}
    assert latest.model_tree(mapped.limit(0)).collect() == []


POINTERS = {
    "": MODEL,
    "/vessels": {k: v for k, v in MODEL.items() if k != "solo"},
    "/vessels/c": {"vessels.c": MODEL["vessels.c"]},
    "/vessels/urn:a.b/nav/pos": {"vessels.urn:a.b": MODEL["vessels.urn:a.b"]["nav"]["pos"]},
    "/vessels/urn:a.b/nav/pos/value/lat": {"vessels.urn:a.b": 1.5},
    '/vessels/urn:a.b/say "hi"/q\\/source/uuid': {"vessels.urn:a.b": "u3"},
    "/vessels/urn:a.b/mmsi": {"vessels.urn:a.b": "5"},
    "/solo/a": {"solo": MODEL["solo"]["a"]},
    "/vessels/none": {},
    "/vessels/c/x/none": {},
    "/vessels/c~1d": {},
}


@pytest.mark.parametrize("text", POINTERS)
def test_pointer(mapped, text):
    assert {r.context: json.loads(r.document) for r in latest.pointer(mapped, text).collect()} == POINTERS[text]


def test_pointer_reaches_the_scan(spark, mapped, tmp_path):
    mapped.write.parquet(str(tmp_path / "m"))
    plan = latest.pointer(spark.read.parquet(str(tmp_path / "m")), "/vessels/c/x")._jdf.queryExecution().toString()
    assert "In(context, [vessels,vessels.c]" in plan.replace("vessels.c,vessels]", "vessels,vessels.c]")


NOTE = '[{{"message":"{}"}}]'.format
FOLDS = {
    "scalar then lists": (["5", NOTE("a"), NOTE("b")], '[{"message":"a"},{"message":"b"}]'),
    "list scalar list": ([NOTE("a"), "5", NOTE("b")], NOTE("b")),
    "two element types": ([NOTE("a"), "[1,2]", "[3.5]"], "[3.5]"),
    "same numbers": (["[1.5]", "[2.5,3.5]"], "[1.5,2.5,3.5]"),
    "empty lists": ([NOTE("a"), "[]", NOTE("b")], '[{"message":"a"},{"message":"b"}]'),
    "only empty": (["[]", "[ ]"], "[]"),
    "last is scalar": ([NOTE("a"), NOTE("b"), '"x"'], '"x"'),
    "null": ([NOTE("a"), None], None),
}


def test_fold_of_a_path(spark):
    rows = [(name, "p", k, v) for name, (values, _) in FOLDS.items() for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "msg string, path string, value_no int, value string")
    got = {r.msg: (r.value, r.value_no) for r in flatten.merge_same_path(df, ["msg"]).collect()}
    assert got == {name: (want, len(values) - 1) for name, (values, want) in FOLDS.items()}


SHAPED = "seq long, context string, path string, time timestamp_ntz, shape string, a string, b string, l array<double>"


def shaped(spark, rows):
    return spark.createDataFrame([(k, "c", "p", T0 + datetime.timedelta(seconds=t), s, a, b, l) for k, (t, s, a, b, l) in enumerate(rows)], SHAPED)


def test_vessel_shapes_merge_and_stay_below_a_spectrum(spark):
    rows = [(0, "vesselInfo", "mmsi", None, []), (1, "vesselInfo", None, "name", []), (2, "vesselType", "1", None, []), (3, "vesselType", None, "tug", []), (4, "spectrum", "s", None, [1.0]), (5, "vesselInfo", "x", "y", [])]
    out = state.merged_shapes(shaped(spark, rows), ["a", "b"], ["l"]).orderBy("seq").collect()
    assert [(r.shape, r.a, r.b) for r in out] == [("vesselInfo", "mmsi", None), ("vesselInfo", "mmsi", "name"), ("vesselType", "1", None), ("vesselType", "1", "tug"), ("spectrum", "s", None), ("spectrum", "s", None)]


def test_changes_compare_with_what_is_merged(spark):
    rows = [
        (0, "position", "1", None, []),
        (1, "position", None, "2", []),  # merges to (1, 2)
        (2, "position", "1", "2", None),  # is what is stored
        (0, "position", "7", "7", []),  # late
        (2, "position", "1", None, []),  # differs from what is stored, merges to the same
        (3, "draft", "5", None, [1.0]),
        (4, "draft", None, "6", []),
        (5, "text", "t", None, []),
    ]
    out = state.merged_changes(shaped(spark, rows), ["a", "b"], ["l"]).orderBy("seq").collect()
    assert [(r.seq, r.a, r.b, r.l) for r in out] == [(0, "1", None, []), (1, "1", "2", []), (4, "1", "2", []), (5, "5", None, [1.0]), (6, "5", "6", [1.0]), (7, "t", None, [])]
    assert state.merged_changes(shaped(spark, []), ["a", "b"], ["l"]).collect() == []


def test_talker_groups():
    assert len(export.TALKERS) == 65 and export.TALKERS["WI"] == "NAVD" and export.TALKERS["AI"] == "TGTD"


def test_retention_prunes_days(spark, tmp_path):
    from pyspark.sql import functions as F

    from brinelake.operators import upsert

    rows = [(T0 + datetime.timedelta(days=k), "o", "c", "p", k) for k in range(20)]
    upsert.append(spark.createDataFrame(rows, "time timestamp_ntz, origin string, context string, path string, seq long"), str(tmp_path / "t"))
    kept = upsert.retain(spark.read.parquet(str(tmp_path / "t")), F.lit(T0 + datetime.timedelta(days=19)), "7 DAYS")
    assert sorted(r.seq for r in kept.collect()) == list(range(12, 20))
    scan = next(line for line in kept._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line)
    assert "date" in scan.split("PartitionFilters: [")[1].split("]")[0]
