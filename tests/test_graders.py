from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.templates import judge_prompt, template_column
from gradeloom.operators import graders, inference, schema_check


def rows(spark, *pairs):
    return spark.createDataFrame(
        [(i, e, a) for i, (e, a) in enumerate(pairs)], "id int, expected_output string, actual_output string")


def run(df, *definitions, context=None, default_model="judge-1"):
    context = context or graders.Context(item={"input": "expected_output"})
    built = graders.build_graders(list(definitions), context, default_model)
    return graders.grade(df, built).orderBy("id").collect()


def verdicts(df, definition, **kwargs):
    name = definition["name"]
    return [r["details"][name] for r in run(df, definition, **kwargs)]


# --- templates ----------------------------------------------------------------


@pytest.mark.parametrize(
    "template, expected",
    [
        ("{{ item.q }} / {{sample.output_text}}", "Q1 / out"),
        ("{{ item.q }}{{ item.q }}", "Q1Q1"),
        ("no placeholders", "no placeholders"),
        ("{{ item.none }} {{ other.x }} {{ item }}", "{{ item.none }} {{ other.x }} {{ item }}"),
        ("{ item.q } {{ item.q", "{ item.q } {{ item.q"),
        ("", ""),
    ],
)
def test_templates(spark, template, expected):
    df = spark.createDataFrame([("Q1", "out", {"q": "Q1"})], "q string, o string, m map<string,string>")
    for item in ({"q": F.col("q")}, F.col("m")):
        assert df.select(template_column(template, item, F.col("o"))).first()[0] == expected


def test_judge_prompt_keeps_braces(spark):
    df = spark.createDataFrame([('{"a": {actual}}', "x")], "e string, a string")
    got = df.select(
        judge_prompt("{expected} vs {actual} {other}", F.col("e"), F.col("a")), judge_prompt("Rate", F.col("e"), F.col("a"))).first()
    assert got[0] == '{"a": {actual}} vs x {other}'
    assert got[1] == 'Rate\n\nExpected output:\n{"a": {actual}}\n\nActual output:\nx'


# --- native graders -------------------------------------------------------------


@pytest.mark.parametrize(
    "operation, actual, passed",
    [("equals", "cat", True), ("equals", "Cat", False), ("not_equals", "dog", True), ("contains", "a cat!", True),
     ("contains", "A CAT", False), ("contains_ignore_case", "A CAT", True), ("contains_ignore_case", "dog", False)],
)
def test_string_check(spark, operation, actual, passed):
    definition = {"type": "string_check", "name": "s", "operation": operation,
                  "input_value": "{{ sample.output_text }}", "reference_value": "{{ item.input }}"}
    got = verdicts(rows(spark, ("cat", actual)), definition)[0]
    assert (got["score"], got["passed"]) == (1.0 if passed else 0.0, passed)


def test_empty_reference_is_contained_everywhere(spark):
    definition = {"type": "string_check", "name": "s", "operation": "contains", "input_value": "x", "reference_value": ""}
    assert verdicts(rows(spark, ("", "y")), definition)[0]["passed"] is True


def test_null_threshold_makes_a_grader_informational(spark):
    definition = {"type": "exact_match", "name": "e", "threshold": None}
    got = run(rows(spark, ("a", "a")), definition)[0]
    assert got["details"]["e"]["passed"] is None and got["score"] == 1.0 and got["passed"] is None


def test_unknown_operation_scores_zero_with_an_error(spark):
    got = verdicts(rows(spark, ("a", "a")), {"type": "string_check", "name": "s", "operation": "resembles"})[0]
    assert (got["score"], got["passed"], got["error"]) == (0.0, False, "Unknown operation: resembles")


def test_registry(spark):
    with pytest.raises(ValueError, match="Unknown grader: 'nope'. Available: .*string_check"):
        graders.build_graders([{"type": "nope", "name": "x"}], graders.Context())

    @graders.register_grader("always")
    def always(definition, context, slot):
        return graders.Grader(definition["name"], 1.0, lambda df: df, graders.verdict_struct(definition, F.lit(1.0)))

    try:
        assert "always" in graders.grader_types()
        assert run(rows(spark, ("a", "b")), {"type": "always", "name": "yes"})[0]["passed"] is True
    finally:
        graders._BUILDERS.pop("always")


def test_cosine_uses_whole_norms_and_the_shared_length(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0, 2.0]), ([], [1.0])],
        "a array<float>, b array<float>")
    got = [r[0] for r in df.select(graders.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, round(5 / (5**0.5 * 3), 4), 0.0]


def test_semantic_grader_embeds_distinct_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = rows(spark, *[("abc", "abc"), ("abc", "a"), (None, "abc")] * 20)
    definition = {"type": "semantic_similarity", "name": "near", "embedder": embed, "spread_by": ["id"]}
    got = verdicts(df, definition)
    assert got[0]["score"] == 1.0 and got[1]["score"] == 0.8944 and got[0]["passed"] is True
    assert (got[2]["score"], got[2]["passed"], got[2]["error"]) == (None, False, "no embedding")
    assert calls.value == 2


# --- JSON -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "actual, expected, score, error",
    [
        ('{"key": " Yes "}', "yes", 1.0, None),
        ('{"a": [{"b": {"key": "deep"}}]}', "deep", 1.0, None),
        ('{"a": {"key": "inner"}, "key": "own"}', "own", 1.0, None),
        ('{"a": {"x": {"key": "first"}}, "b": {"key": "second"}}', "first", 1.0, None),
        ('[{"z": 1}, {"key": true}]', "TRUE", 1.0, None),
        ('{"key": null}', "none", 1.0, None),
        ('{"key": 1.0}', "1.0", 1.0, None),
        ('{"key": "no"}', "yes", 0.0, None),
        ('{"other": 1}', "x", 0.0, "Field 'key' not found in response"),
        ("not json", "x", 0.0, "Failed to parse actual output as JSON"),
        (None, "x", 0.0, "Failed to parse actual output as JSON"),
    ],
)
def test_json_field(spark, actual, expected, score, error):
    got = verdicts(rows(spark, (expected, actual)), {"type": "json_field", "name": "f"})[0]
    assert (got["score"], got["error"]) == (score, error)


def test_json_fields_of_many_graders_take_one_python_pass(spark):
    texts = [
        '{"a": 1, "b": {"c": "x", "a": 2}}', '{"b": [{"c": {"z": null}}, {"a": true}], "c": 2.0}', '[[{"a": [1]}], {"c": "y"}]',
        '{"\\u0061": "spelt"}', "no json", "", None, '{"k": {"a": {"a": "inner"}}}', '{"z": "a c"}', '"a"',
    ]
    names = ["a", "c", "z", "a"]
    df = rows(spark, *[("x", t) for t in texts])
    definitions = [{"type": "json_field", "name": f"g{i}", "field_name": n} for i, n in enumerate(names)]
    graded = graders.grade(df, graders.build_graders(definitions, graders.Context()))
    assert graded._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

    def first(node, name):
        if isinstance(node, dict):
            if name in node:
                return [node[name]]
            node = list(node.values())
        return next((hit for part in node if (hit := first(part, name))), []) if isinstance(node, list) else []

    for row in graded.collect():
        for i, name in enumerate(names):
            got = row["details"][f"g{i}"]
            try:
                hit = first(json.loads(row["actual_output"]), name)
            except (TypeError, ValueError):
                assert got["error"] == "Failed to parse actual output as JSON"
                continue
            assert got["error"] == (None if hit else f"Field '{name}' not found in response")
            assert json.loads(got["details_json"]).get("extracted_value") == (str(hit[0]) if hit else None)


def test_json_field_options(spark):
    df = rows(spark, ("Yes", '{"label": "yes "}'))
    def ask(**more):
        return verdicts(df, {"type": "json_field", "name": "f", "field_name": "label", **more})[0]["score"]

    assert (ask(), ask(case_sensitive=True), ask(strip_whitespace=False)) == (1.0, 0.0, 0.0)
    assert ask(path="$.label") == 1.0


SCHEMA = {
    "type": "object",
    "properties": {
        "reply": {"type": "string", "minLength": 2, "pattern": "^[a-z]"},
        "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 10},
        "kind": {"enum": ["x", 1, None]},
        "list": {"type": "array", "minItems": 1, "items": {"type": ["number", "null"]}},
    },
    "required": ["reply"],
    "additionalProperties": False,
}


@pytest.mark.parametrize(
    "actual, path, rule, message",
    [
        ('{"reply": "ok", "n": 3.0, "kind": null, "list": [1, 2.5, null]}', None, None, None),
        ('{"reply": 3}', "$.reply", "$.properties.reply.type", "3 is not of type 'string'"),
        ("{}", "$", "$.required", "'reply' is a required property"),
        ('{"reply": "ok", "z": 1, "a": 2}', "$", "$.additionalProperties",
         "Additional properties are not allowed ('a', 'z' were unexpected)"),
        ('{"reply": "o"}', "$.reply", "$.properties.reply.minLength", "'o' is too short"),
        ('{"reply": "Ok"}', "$.reply", "$.properties.reply.pattern", "'Ok' does not match '^[a-z]'"),
        ('{"reply": "ok", "n": 2.5}', "$.n", "$.properties.n.type", "2.5 is not of type 'integer'"),
        ('{"reply": "ok", "n": true}', "$.n", "$.properties.n.type", "True is not of type 'integer'"),
        ('{"reply": "ok", "n": 0}', "$.n", "$.properties.n.minimum", "0 is less than the minimum of 1"),
        ('{"reply": "ok", "n": 10}', "$.n", "$.properties.n.exclusiveMaximum", "10 is greater than or equal to the maximum of 10"),
        ('{"reply": "ok", "kind": "y"}', "$.kind", "$.properties.kind.enum", "'y' is not one of ['x', 1, None]"),
        ('{"reply": "ok", "list": []}', "$.list", "$.properties.list.minItems", "[] should be non-empty"),
        ('{"reply": "ok", "list": [1, "a"]}', "$.list[1]", "$.properties.list.items.type", "'a' is not of type 'number', 'null'"),
        ("[1]", "$", "$.type", "[1] is not of type 'object'"),
        ('{"reply": "ok", "reply": 5}', "$.reply", "$.properties.reply.type", "5 is not of type 'string'"),
    ],
)
def test_schema_violations(spark, actual, path, rule, message):
    df = rows(spark, ("", actual))
    got = schema_check.validate(df, "actual_output", SCHEMA, "c").first()["c"]
    assert (got["validation_path"], got["schema_path"], got["validation_message"]) == (path, rule, message)
    assert got["valid"] is (message is None)


def test_schema_grader_parse_failures(spark):
    df = rows(spark, ("", "not json"), ("", "  "), ("", '{"a": 1'), ("", "x " * 200))
    got = verdicts(df, {"type": "json_schema", "name": "j", "schema": SCHEMA})
    assert all(v["score"] == 0.0 and v["passed"] is False for v in got)
    assert "line 1, column 1" in got[0]["error"] and "'n'" in got[0]["error"]
    assert got[0]["error"].endswith("Output preview: 'not json'")
    assert got[1]["error"].endswith("empty or whitespace only. Output preview: (empty response)")
    assert "column 8" in got[2]["error"]
    assert got[3]["error"].endswith("x...'") and len(got[3]["error"]) < 500


def test_schema_must_be_known(spark):
    with pytest.raises(ValueError, match="requires a schema"):
        graders.build_graders([{"type": "json_schema", "name": "j"}], graders.Context())
    with pytest.raises(ValueError, match="unsupported JSON schema keywords: unevaluatedItems"):
        schema_check.violations({"anyOf": [{"unevaluatedItems": False}]}, F.try_parse_json(F.lit("{}")))
    with pytest.raises(ValueError, match="unknown JSON schema reference"):
        schema_check.violations({"$ref": "#/$defs/none"}, F.try_parse_json(F.lit("{}")))


def test_nested_additional_properties_schema(spark):
    schema = {"type": "object", "additionalProperties": {"type": "integer"}}
    got = schema_check.validate(rows(spark, ("", '{"a": 1, "b": "x"}')), "actual_output", schema, "c").first()["c"]
    assert got["validation_path"] == "$.b" and got["validation_message"] == "'x' is not of type 'integer'"


# --- user code --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source, score, error",
    [
        ("def grade(sample, item):\n    return 1.0 if sample['output_text'] == item['input'] else 0.0", 1.0, None),
        ("def grade(sample, item):\n    return 7", 1.0, None),
        ("def grade(sample, item):\n    return -3", 0.0, None),
        ("def grade(sample, item):\n    return float('nan')", 1.0, None),
        ("import math\nimport re\ndef grade(s, i):\n    return math.floor(len(re.findall('a', s['output_text'])))", 1.0, None),
        ("def grade(sample, item:\n    return 1", 0.0, "Execution error"),
        ("x = 1", 0.0, "must define a callable"),
        ("grade = 5", 0.0, "must define a callable"),
        ("def grade(sample, item):\n    return 1 / 0", 0.0, "grade() raised: division by zero"),
        ("def grade(sample, item):\n    return 'text'", 0.0, "grade() raised"),
        ("import os\ndef grade(s, i):\n    return 1", 0.0, "Import of 'os' is not allowed. Available modules: json, math, re"),
        ("def grade(s, i):\n    return open('/tmp/x')", 0.0, "name 'open' is not defined"),
        ("", 0.0, "must define a callable"),
    ],
)
def test_python_grader(spark, source, score, error):
    got = verdicts(rows(spark, ("cat", "cat")), {"type": "python", "name": "p", "source_code": source})[0]
    assert got["score"] == score
    assert (error is None and got["error"] is None) or error in got["error"]


# --- judge and generation ------------------------------------------------------------------


def test_judge_replies(spark):
    replies = ['{"score": 0.9, "reasoning": "fine"}', '{"score": "0.4"}', "{}", "junk", '{"score": 1.4}', "[1]", '{"score": "high"}', '{"score": null}', "null"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [tuple(r[0]) for r in df.select(graders.parse_judge_reply(F.col("r"))).collect()]
    prefix = "Failed to parse grader response: "
    assert got == [
        (0.9, "fine", None), (0.4, "", None), (0.0, "", None), (0.0, prefix + "junk", None), (1.4, "", None),
        (None, None, "'list' object has no attribute 'get'"), (0.0, prefix + '{"score": "high"}', None),
        (None, None, "float() argument must be a string or a real number, not 'NoneType'"),
        (None, None, "'NoneType' object has no attribute 'get'")]


def test_prompt_grader_uses_the_default_model_and_reports_failures(spark):
    def judge(request):
        prompt = request["input"][1]["content"]
        if "boom" in prompt:
            raise RuntimeError("no quota")
        return inference.Reply(json.dumps({"score": 0.8, "reasoning": request["model"] + str(request.get("temperature"))}))

    got = run(rows(spark, ("a", "b"), ("a", "boom")),
              {"name": "tone", "prompt": "{expected}:{actual}", "provider": judge},
              {"type": "exact_match", "name": "same", "weight": 0.5}, default_model="plain")
    assert got[0]["details"]["tone"]["reasoning"] == "plain0.0" and got[0]["details"]["tone"]["passed"] is True
    failed = got[1]["details"]["tone"]
    assert (failed["score"], failed["passed"], failed["error"]) == (None, False, "no quota")
    assert got[1]["score"] == 0.0 and got[1]["passed"] is False


def test_repeated_names_share_the_last_weight(spark):
    got = run(rows(spark, ("a", "A")), {"type": "exact_match", "name": "x", "weight": 1.0},
              {"type": "exact_match", "name": "x", "case_sensitive": False, "weight": 0.5})[0]
    assert list(got["details"]) == ["x"] and got["details"]["x"]["score"] == 1.0
    assert got["score"] == 0.5 and got["passed"] is False


def test_generation_errors_leave_rows_ungraded(spark):
    def provider(request):
        prompt = request["input"][1]["content"]
        if prompt == "bad":
            raise ValueError("refused")
        return inference.Reply(prompt[::-1], 3, 4)

    work = spark.createDataFrame([(0, "abc", "cba"), (1, "bad", "x")], "id int, input string, expected_output string")
    answered = inference.evaluate_rows(work, provider, system_prompt=F.lit("s"), model=F.lit("o3"))
    got = run(answered, {"type": "exact_match", "name": "same"})
    assert (got[0]["actual_output"], got[0]["passed"], got[0]["input_tokens"], got[0]["error"]) == ("cba", True, 3, None)
    assert got[0]["latency_ms"] >= 0
    assert (got[1]["actual_output"], got[1]["error"], got[1]["details"], got[1]["score"], got[1]["passed"]) == (
        None, "refused", None, None, None)


def test_request_column(spark):
    df = spark.createDataFrame([("plain", None), ("o3", None), ("plain", "low")], "m string, effort string")
    request = inference.request_column(
        model=F.col("m"), system_prompt=F.lit("sys"), user_input=F.lit('say "hi"'), temperature=F.lit(0.5), max_tokens=F.lit(9),
        tools=F.array(F.lit("file_search"), F.lit("other"), F.lit("shell")),
        tool_options=F.create_map(F.lit("vector_store_id"), F.lit("vs"), F.lit("tool_choice"), F.lit("auto")),
        reasoning_effort=F.col("effort"), format_type=F.lit("json_schema"), format_label=F.lit("my name"))
    got = [json.loads(r[0]) for r in df.select(request).collect()]
    assert got[0] == {
        "model": "plain", "temperature": 0.5, "max_output_tokens": 9,
        "input": [{"role": "system", "content": "sys"}, {"role": "user", "content": 'say "hi"'}],
        "tools": [{"type": "file_search", "vector_store_ids": ["vs"]}, {"type": "shell", "environment": {"type": "container_auto"}}],
        "text": {"format": {"type": "json_schema", "name": "my_name"}},
    }
    assert "temperature" not in got[1] and "reasoning" not in got[1]
    assert "temperature" not in got[2] and got[2]["reasoning"] == {"effort": "low"}
