from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions.mapping import (
    infer_record_type,
    json_record,
    map_records,
    path_steps,
    typed_record,
)
from gradeloom.sources import records


def mapped(spark, items, mapping, schema=None, columns=None):
    """Map records given as Python objects, in their order."""
    rows = [(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(items)]
    df = spark.createDataFrame(rows, "pos int, body string")
    record = json_record("body", schema or infer_record_type(df, "body"))
    out = map_records(df, record, mapping, columns, keep=["pos"]).orderBy("pos")
    return [{k: v for k, v in r.asDict().items() if k != "pos"} for r in out.collect()]


def one(spark, item, text, schema=None):
    return mapped(spark, [item], {"v": text}, schema)[0]["v"]


BOOK = {
    "title": "Rivers", "pages": 120, "price": 9.5, "new": True, "none": None,
    "authors": ["Ann", "Bo"], "empty": [], "parts": [{"t": "One", "n": 3}, {"t": "Two", "n": 12}],
    "extra": {"key": "é", "more": [1, 2]},
}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("title", "Rivers"),
        ("$.title", "Rivers"),
        ("parts[1].t", "Two"),
        ("parts[5].t", ""),
        ("parts[].t", '["One","Two"]'),
        ("authors", '["Ann","Bo"]'),
        ("authors[]", '["Ann","Bo"]'),
        ("extra", '{"key":"é","more":[1,2]}'),
        ("extra.more[0]", "1"),
        ("title.x", ""),
        ("unknown.path", ""),
        ("new", "True"),
        ("price", "9.5"),
        ("none", ""),
        ("", ""),
        ('"quoted"', "quoted"),
        ("true", "True"),
        ("3.50", "3.5"),
        ("Title: {title} ({pages} pages)", "Title: Rivers (120 pages)"),
        ("{title}{ title }", "RiversRivers"),
        ("{missing}-{empty}", "-[]"),
        ('{new ? "fresh" : "used"}', "fresh"),
        ('{pages > 100 ? "long" : "short"}', "long"),
        ('{"12" = 12 ? "same" : "other"}', "same"),
        ('{true == 1 ? "same" : "other"}', "same"),
        ('{true > 0 ? "more" : "none"}', "none"),
        ('{title > "Q" ? "late" : "early"}', "late"),
        ('{title < 5 ? "less" : "not"}', "not"),
        ('{none == null ? "null" : "set"}', "null"),
        ('{parts[].n > 10 ? "big" : "small"}', "big"),
        ('{parts[].t == "Two" ? parts[].t : "no"}', '["One","Two"]'),
        ('{parts[].t != "Two" ? "none" : "some"}', "some"),
        ('{empty ? "items" : "nothing"}', "nothing"),
        ('{"0" ? "yes" : "no"}', "yes"),
        ('{pages == 1 ? "a" : pages == 120 ? "b" : "c"}', "b"),
        ('find(parts, t == "Two").n', "12"),
        ('find(parts, t = "Nine").n', ""),
        ("nofunction(title)", ""),
        ("find(parts)", ""),
    ],
)
def test_expressions(spark, text, expected):
    assert one(spark, BOOK, text) == expected


def test_parse_json_paths(spark):
    inner = {"label": "bill.refund", "sure": 88, "deep": {"tags": ["a", "b"]}, "ok": True, "word": "true"}
    item = {"id": 7, "out": json.dumps(inner), "bad": "{oops", "st": {"label": "kept"}}
    got = mapped(
        spark, [item],
        {
            "a": "parse_json(out).label", "b": "parse_json(out).sure", "c": "parse_json(out).deep.tags",
            "d": "parse_json(bad).label", "e": "parse_json(st).label", "f": "{parse_json(out).sure > 80 ? parse_json(out).label : \"low\"}",
            "g": "#{id} {parse_json(out).label} ({parse_json(out).sure}%)", "h": "parse_json(out).ok", "i": "parse_json(out).word",
            "j": "parse_json(out).deep.tags[1]", "k": "parse_json(out).deep.tags[]",
            "l": '{parse_json(out).ok ? "y" : "n"}', "m": '{parse_json(out).none ? "y" : "n"}',
        },
    )[0]
    assert got == {
        "a": "bill.refund", "b": "88", "c": '["a","b"]', "d": "", "e": "kept", "f": "bill.refund",
        "g": "#7 bill.refund (88%)", "h": "True", "i": "true", "j": "b", "k": '["a","b"]', "l": "y", "m": "n",
    }


def test_find_and_parse_json_combine(spark):
    item = {"meta": [{"k": "ctx", "v": '{"lot": 55, "who": "seller"}'}, {"k": "lot", "v": "55"}]}
    got = mapped(
        spark, [item],
        {
            "who": 'parse_json(find(meta, k == "ctx").v).who', "lot": 'parse_json(find(meta, k == "ctx").v).lot',
            "all": 'parse_json(find(meta, k == "ctx").v)', "text": 'lot={find(meta, k == "lot").v}',
        },
    )[0]
    assert got == {"who": "seller", "lot": "55", "all": '{"lot":55,"who":"seller"}', "text": "lot=55"}


def test_nested_wildcards_splice(spark):
    item = {"logs": [{"m": [{"id": 12}, {"id": 8}]}, {"m": [{"id": 1}]}, {}]}
    assert one(spark, item, "logs[].m[].id") == "[12,8,1]"
    assert one(spark, item, '{logs[].m[].id = 8 ? "hit" : "miss"}') == "hit"


def test_inferred_schemas_keep_number_forms(spark):
    items = [
        {"whole": 1.0, "mix": 1, "long": 12345678901234567890, "any": 0, "flag": True, "deep": {"n": 7}},
        {"whole": 2.0, "mix": 2.5, "long": 3, "any": "0", "flag": "true", "deep": {"n": 0.25}},
        {"whole": 0.0, "mix": 0, "long": 4, "any": False, "flag": None, "deep": {}},
    ]
    mapping = {name: name for name in ("whole", "mix", "long", "any", "flag")}
    mapping |= {"t": '{any ? "y" : "n"}', "z": '{mix ? "y" : "n"}', "e": '{any == 0 ? "y" : "n"}', "d": "deep.n"}
    got = mapped(spark, items, mapping)
    assert got == [
        {"whole": "1.0", "mix": "1", "long": "12345678901234567890", "any": "0", "flag": "True", "t": "n", "z": "y", "e": "y", "d": "7"},
        {"whole": "2.0", "mix": "2.5", "long": "3", "any": "0", "flag": "true", "t": "y", "z": "y", "e": "y", "d": "0.25"},
        {"whole": "0.0", "mix": "0", "long": "4", "any": "False", "flag": "", "t": "n", "z": "n", "e": "y", "d": ""},
    ]


def test_missing_colon_is_an_error(spark):
    with pytest.raises(ValueError, match="':'"):
        one(spark, BOOK, '{new ? "a"}')


def test_columns_without_mapping_are_empty(spark):
    got = mapped(spark, [BOOK], {"input": "title"}, columns=["input", "other"])
    assert got == [{"input": "Rivers", "other": ""}]


def test_path_steps():
    assert path_steps("$.a[0].b[].c") == ["a", 0, "b", None, "c"]
    assert path_steps("$") == [] and path_steps(None) == []


scalar = st.one_of(st.none(), st.booleans(), st.integers(-50, 50), st.text("ab1.0-\"'tre", max_size=5))


def as_python(value):
    """The rule for comparing scalars, written down once more for the check."""
    if isinstance(value, str):
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            return value[1:-1]
        known = {"true": True, "false": False, "null": None}
        if value in known:
            return known[value]
        try:
            digits = value.lstrip("-")
            if value.count("-") == len(value) - len(digits) <= 1 and all(p.isdigit() for p in digits.split(".")) and digits.count(".") <= 1:
                return float(value)
        except ValueError:
            pass
    return value


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(scalar, scalar), min_size=20, max_size=40))
def test_scalar_equality_matches_python(spark, pairs):
    texts = [(i, json.dumps({"a": a, "b": b})) for i, (a, b) in enumerate(pairs)]
    # Records of one type combination share a schema, as a table would.
    kinds = {}
    for (i, body), (a, b) in zip(texts, pairs):
        kinds.setdefault((type(a), type(b)), []).append((i, body))
    ddl = {type(None): "string", bool: "boolean", int: "bigint", str: "string"}
    for (ka, kb), rows in kinds.items():
        df = spark.createDataFrame(rows, "pos int, body string")
        record = json_record("body", f"struct<a:{ddl[ka]},b:{ddl[kb]}>")
        out = map_records(df, record, {"v": '{a == b ? "y" : "n"}'}, keep=["pos"]).collect()
        for row in out:
            a, b = pairs[row["pos"]]
            assert row["v"] == ("y" if as_python(a) == as_python(b) else "n"), (a, b)


def test_typed_and_json_records_agree(spark):
    rows = [(1, "x", [1.5, 2.0]), (2, None, [])]
    df = spark.createDataFrame(rows, "id long, name string, vals array<double>").select(
        F.struct("id", "name", "vals").alias("r"))
    texts = df.select("r", F.to_json("r").alias("body"))
    mapping = {"a": "name", "b": "vals[0]", "c": "vals", "d": "n{id}", "e": '{vals[] > 1.7 ? "hi" : "lo"}'}
    typed = map_records(texts, typed_record(texts, "r"), mapping).collect()
    parsed = map_records(texts, json_record("body", "struct<id:bigint,name:string,vals:array<double>>"), mapping).collect()
    assert typed == parsed


# --- records ------------------------------------------------------------------


def test_extract_records(spark):
    body = json.dumps({"data": {"items": [{"q": 1, "tags": ["x", "y"]}, {"q": 2, "tags": ["z"]}]}, "n": 5})
    df = spark.createDataFrame([(1, body), (2, '{"data": {}}')], "id int, body string")
    ddl = "struct<data:struct<items:array<struct<q:int,tags:array<string>>>>,n:int>"
    payload = json_record("body", ddl)
    got = records.extract_records(df, payload, "$.data.items", ["id"]).select("id", "record_index", "record.q").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1), (1, 1, 2)]
    tags = records.extract_records(df, payload, "$.data.items[].tags", ["id"]).collect()
    assert [r["record"] for r in tags] == ["x", "y", "z"]
    with pytest.raises(ValueError, match="list"):
        records.extract_records(df, payload, "$.n", ["id"])
    assert records.extract_records(df, payload, "$.none", ["id"]).count() == 0


def test_extract_untyped_records_checks_each_payload(spark):
    df = spark.createDataFrame([(1, '{"items": [{"q": 1}]}'), (2, '{"items": 3}')], "id int, body string")
    good = records.extract_json_records(df.filter("id = 1"), "body", "$.items", ["id"]).collect()
    assert [r["record"] for r in good] == ['{"q":1}']
    with pytest.raises(Exception, match="must resolve to a list"):
        records.extract_json_records(df, "body", "$.items", ["id"]).collect()


def test_import_uses_the_snapshot(spark):
    df = spark.createDataFrame([('{"q": "new", "a": "A"}',)], "body string")
    record = json_record("body", "struct<q:string,a:string>")
    snapshot = records.import_snapshot("s1", "$.items", {"input": "q", "expected_output": "a"})
    old = spark.createDataFrame([("old", "O")], "input string, expected_output string")
    both = records.append_from_source(old, ["input", "expected_output"], snapshot, df, record)
    assert sorted(tuple(r) for r in both.collect()) == [("new", "A"), ("old", "O")]
    with pytest.raises(ValueError, match="continuing import"):
        records.append_from_source(old, ["input", "expected_output"], None, df, record)
    with pytest.raises(ValueError, match="must include"):
        records.import_rows(df, record, records.import_snapshot("s", "$", {"input": "q"}))


def test_ready_rows_need_every_column(spark):
    df = spark.createDataFrame([(1, None)], "input int, expected_output string")
    assert [tuple(r) for r in records.ready_rows(df, ["input", "expected_output"]).collect()] == [("1", "")]
    with pytest.raises(ValueError, match="every dataset column"):
        records.ready_rows(df, ["input", "label"])
