"""JSON schemas: combined rules as columns, recursive ones along the document."""

from __future__ import annotations

import json
import random

import pytest

from gradeloom.operators import schema_check, schema_rules, schema_walk


def first(spark, schema, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = schema_check.validate(df, "t", schema, "c").orderBy("i").select("c.*").collect()
    return [(r.validation_path, r.schema_path, r.validation_message) for r in found]


NONE = (None, None, None)
NODE = {"$defs": {"node": {"type": "object", "properties": {"v": {"type": "integer"}, "next": {"anyOf": [{"$ref": "#/$defs/node"}, {"type": "null"}]},
        "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}, "required": ["v"], "additionalProperties": False}}, "$ref": "#/$defs/node"}

CASES = [
    ({"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, '{"a": 3}', ("$.a", "$.properties.a.anyOf", "3 is not valid under any of the given schemas")),
    ({"properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}}}, '{"a": null}', NONE),
    ({"anyOf": [{"required": ["a"]}, {"required": ["b"]}]}, '{"b": 1}', NONE),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, "3", ("$", "$.oneOf", "3 is valid under each of {'minimum': 2}, {'type': 'integer'}")),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, "2.5", NONE),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, "1.5", ("$", "$.oneOf", "1.5 is not valid under any of the given schemas")),
    ({"allOf": [{"type": "object"}, {"required": ["x", "a"]}]}, "{}", ("$", "$.allOf[1].required", "'x' is a required property")),
    ({"not": {"type": "string"}}, '"s"', ("$", "$.not", "'s' should not be valid under {'type': 'string'}")),
    ({"$ref": "#/$defs/p", "$defs": {"p": {"properties": {"a": {"$ref": "#/$defs/q"}}}, "q": {"type": "string"}}}, '{"a": 1}', ("$.a", "$.properties.a.type", "1 is not of type 'string'")),
    ({"$ref": "#q", "$defs": {"x~/y": {"$anchor": "q", "const": 1}}}, "2", ("$", "$.const", "1 was expected")),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, '{"a": 1}', ("$", "$.then.required", "'b' is a required property")),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, "{}", ("$", "$.else.required", "'c' is a required property")),
    ({"multipleOf": 0.5}, "1.25", ("$", "$.multipleOf", "1.25 is not a multiple of 0.5")),
    ({"uniqueItems": True}, '[1.5, {"a": 1}, 1.50]', ("$", "$.uniqueItems", '[1.5,{"a":1},1.5] has non-unique elements')),
    ({"uniqueItems": True}, '[1, 1.0]', ("$", "$.uniqueItems", "[1,1] has non-unique elements")),
    ({"uniqueItems": True}, '[1, "1", true, null]', NONE),
    ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, '{"n1": "x", "n2": 1}', ("$.n1", "$.patternProperties.^n.type", "'x' is not of type 'integer'")),
    ({"patternProperties": {"^n": {}}, "additionalProperties": False}, '{"z": 1, "n": 1}', ("$", "$.additionalProperties", "'z' does not match any of the regexes: '^n'")),
    ({"minProperties": 2}, '{"a": 1}', ("$", "$.minProperties", '{"a":1} does not have enough properties')),
    ({"maxProperties": 0}, '{"a": 1}', ("$", "$.maxProperties", '{"a":1} is expected to be empty')),
    ({"propertyNames": {"maxLength": 2}}, '{"abc": 1}', ("$", "$.propertyNames.maxLength", "'abc' is too long")),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, '["a", "b", 3]', ("$[0]", "$.prefixItems[0].type", "'a' is not of type 'integer'")),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, '[1, "b", 3]', ("$[2]", "$.items.type", "3 is not of type 'string'")),
    ({"prefixItems": [True], "items": False}, "[1, 2]", ("$", "$.items", "Expected at most 1 item but found 1 extra: 2")),
    ({"items": False}, "[1, 2]", ("$", "$.items", "Expected at most 0 items but found 2 extra: [1,2]")),
    ({"contains": {"type": "string"}}, "[1]", ("$", "$.contains", "[1] does not contain items matching the given schema")),
    ({"contains": {"type": "string"}, "minContains": 2}, '["a"]', ("$", "$.contains", "Too few items match the given schema (expected at least 2 but only 1 matched)")),
    ({"contains": {"type": "string"}, "maxContains": 1}, '["a", "b"]', ("$", "$.contains", "Too many items match the given schema (expected at most 1)")),
    ({"dependentRequired": {"a": ["b"]}}, '{"a": 1}', ("$", "$.dependentRequired", "'b' is a dependency of 'a'")),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, '{"a": 1}', ("$", "$.dependentSchemas.a.required", "'b' is a required property")),
    ({"properties": {"a": False}}, '{"a": 1}', ("$.a", "$.properties.a", "False schema does not allow 1")),
    ({"items": {"anyOf": [{"type": "null"}, {"items": {"type": "null"}}]}}, "[null, [null], [1]]", ("$[2]", "$.items.anyOf", "[1] is not valid under any of the given schemas")),
    ({"type": "string", "format": "date", "x-note": 1}, '"no date"', NONE),
    (NODE, '{"v": 1, "next": {"v": 2, "next": null}, "kids": [{"v": 1, "kids": [{"v": 2.5}]}]}', ("$.kids[0].kids[0].v", "$.properties.kids.items.properties.kids.items.properties.v.type", "2.5 is not of type 'integer'")),
    (NODE, '{"v": 1, "next": {"v": 2, "next": {"v": "x"}}}', ("$.next", "$.properties.next.anyOf", '{"next":{"v":"x"},"v":2} is not valid under any of the given schemas')),
    (NODE, json.dumps({"v": 1, "kids": [{"v": 1, "kids": [{"v": 1, "kids": []}] * 3}] * 2}), NONE),
]


@pytest.mark.parametrize("recursive", [False, True])
def test_combined_rules(spark, recursive):
    """Each case as columns and, under a schema that also refers to itself, along the document."""
    for schema, text, want in CASES:
        if recursive and schema is not NODE:
            got = schema_walk.Walk(schema).violations(json.loads(text))
            got = min(((v["path"], v["schema_path"], v["n"], v["message"]) for v in got), default=(None,) * 4)
            assert (got[0], got[1]) == want[:2] and (got[3] == want[2] or "1.0" in text), schema
        elif not recursive:
            assert first(spark, schema, text) == [want], schema


def some_schema(rng, depth=0):
    def inner():
        return some_schema(rng, depth + 1) if rng.random() < 0.9 else rng.random() < 0.5

    choices = [
        lambda: {"type": rng.choice(["integer", "number", "string", "null", "array", "object", "boolean", ["string", "null"]])},
        lambda: {"minimum": rng.randint(0, 3)},
        lambda: {"maxLength": rng.randint(0, 2)},
        lambda: {"enum": rng.sample([1, "a", None, True, "bc"], 2)},
        lambda: {"required": rng.sample("abc", rng.randint(1, 2))},
        lambda: {"minItems": rng.randint(0, 2), "uniqueItems": rng.random() < 0.5},
        lambda: {"maxProperties": rng.randint(0, 2)},
    ]
    if depth < 3:
        choices += [
            lambda: {"properties": {k: inner() for k in rng.sample("abc", 2)}},
            lambda: {"properties": {"a": inner()}, "additionalProperties": rng.choice([False, {"type": "integer"}])},
            lambda: {"patternProperties": {"^[ab]": inner()}},
            lambda: {"items": inner()},
            lambda: {"prefixItems": [inner()], "items": inner()},
            lambda: {rng.choice(["anyOf", "oneOf", "allOf"]): [inner() for _ in range(rng.randint(1, 3))]},
            lambda: {"not": inner()},
            lambda: {"if": inner(), "then": inner(), "else": inner()},
            lambda: {"contains": inner()},
            lambda: {"$ref": "#/$defs/d"},
        ]
    found = {}
    for _ in range(rng.randint(1, 2)):
        found.update(rng.choice(choices)())
    return found


def some_value(rng, depth=0):
    kind = rng.randint(0, 8 if depth < 3 else 5)
    if kind < 6:
        return [rng.randint(0, 4), rng.choice([0.5, 2.5, 1.25]), rng.choice(["", "a", "bc", "é"]), None, True, False][kind]
    if kind == 6:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: some_value(rng, depth + 1) for k in sorted(rng.sample("abcd", rng.randint(0, 3)))}


def test_columns_and_walk_agree(spark):
    rng = random.Random(6)
    texts = [json.dumps(some_value(rng)) for _ in range(60)]
    faults = 0
    for _ in range(25):
        schema = some_schema(rng) | {"$defs": {"d": rng.choice([{"type": "integer"}, {"maxLength": 1}, {"required": ["a"]}, True])}}
        got = first(spark, schema, *texts)
        for text, found in zip(texts, got, strict=True):
            want = schema_walk.Walk(schema).violations(json.loads(text))
            want = sorted((v["path"], v["schema_path"]) for v in want)
            assert found[:2] == (want[0] if want else (None, None)), (schema, text)
            faults += bool(want)
    assert 200 < faults


def test_recursion_is_seen():
    assert schema_rules.is_recursive(NODE)
    assert not schema_rules.is_recursive({"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/b"}, "b": {}}, "allOf": [{"$ref": "#/$defs/b"}] * 2})
    assert schema_rules.is_recursive({"items": {"$ref": "#"}})


def test_counts_of_a_recursive_schema(spark):
    df = spark.createDataFrame([('{"v": "x", "kids": [{"v": 1, "z": 2}]}',), ('{"kids": [{"v": "y"}]}',), ("no",)], "t string")
    got = sorted(map(tuple, schema_check.violation_counts(df, "t", NODE).collect()))
    assert got == [
        ("$", "$.required", 1),
        ("$.kids[]", "$.properties.kids.items.additionalProperties", 1),
        ("$.kids[].v", "$.properties.kids.items.properties.v.type", 1),
        ("$.v", "$.properties.v.type", 1),
    ]


def test_walk_judges_values_without_building_faults(monkeypatch):
    from gradeloom.operators.schema_walk import Walk

    node = {"properties": {"v": {"maximum": 45, "not": {"const": -9}}, "kids": {"type": "array", "items": {"$ref": "#"}}}, "required": ["v"]}
    walk, listed = Walk(node), []
    faults = Walk.faults
    monkeypatch.setattr(Walk, "faults", lambda *a: listed.append(a) or faults(*a))
    assert walk.violations({"v": 45, "kids": [{"v": 1, "kids": [{"v": 2}]}]}) == []
    assert not listed
    found = walk.violations({"v": 46, "kids": [{"kids": [{"v": -9}]}]})
    assert [(f["path"], f["schema_path"]) for f in found] == [
        ("$.v", "$.properties.v.maximum"),
        ("$.kids[0]", "$.properties.kids.items.required"),
        ("$.kids[0].kids[0].v", "$.properties.kids.items.properties.kids.items.properties.v.not"),
    ]
