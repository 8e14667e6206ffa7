"""Queries over graders, templates, judge texts and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.templates import judge_prompt, template_column
from gradeloom.operators import graders, inference, schema_check, summary
from gradeloom.plans import views
from gradeloom.plans.registry import query
from gradeloom.plans.views import SQL_SAMPLES, with_ctes

_SAMPLE_ITEM = graders.Context(item={"input": "input", "expected_output": "expected_output"})


def _verdicts(df, definitions, context, keys, *extra):
    """Grade and flatten: one column group per grader."""
    built = graders.build_graders(definitions, context)
    graded = graders.grade(df, built)
    columns = []
    for g in built:
        v = F.col("details")[g.name]
        columns += [v["score"].alias(f"{g.name}_score"), v["passed"].alias(f"{g.name}_passed")]
        columns += [v[field].alias(f"{g.name}_{field}") for field in extra]
    return graded.select(*keys, *columns, "score", "passed")


# --- templates and string checks ------------------------------------------------


@query("s1_row_template", """
SELECT p_partkey, 'Q: ' || p_name || ' [' || p_brand || '] -> ' || p_type || ' {{ item.none }} {{ other }}' AS rendered FROM part""")
def s1(spark, sf):
    part = views.table(spark, sf, "part")
    item = {"p_name": F.col("p_name"), "brand": F.col("p_brand")}
    text = "Q: {{ item.p_name }} [{{item.brand}}] -> {{ sample.output_text }} {{ item.none }} {{ other }}"
    return part.select("p_partkey", template_column(text, item, F.col("p_type")).alias("rendered"))


@query("s1_row_template_map_item", """
SELECT event_id, 'type=' || event_type || ' k=' || json_extract_string(props, '$.k') || ' {{ item.z }}' AS rendered FROM events""")
def s1_map(spark, sf):
    events = views.table(spark, sf, "events").withColumn("item", F.from_json("props", "map<string,string>"))
    return events.select("event_id", template_column(
        "type={{ sample.output_text }} k={{ item.k }} {{ item.z }}", F.col("item"), F.col("event_type")
    ).alias("rendered"))


_POINTS = "CASE WHEN {0} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _graded_sql(tests: dict[str, str], weights: dict[str, float], limits: dict[str, float | None]) -> str:
    total = sum(w for w in weights.values() if w > 0)
    cols, parts, ands = [], [], []
    for name, test in tests.items():
        points = _POINTS.format(test)
        cols.append(f"{points} AS {name}_score")
        passed = "CAST(NULL AS BOOLEAN)" if limits[name] is None else f"{points} >= {limits[name]}"
        cols.append(f"{passed} AS {name}_passed")
        if weights[name] > 0:
            parts.append(f"{weights[name]}::DOUBLE * {points}")
            if limits[name] is not None:
                ands.append(f"({points} >= {limits[name]})")
    verdict = " AND ".join(ands) if ands else "CAST(NULL AS BOOLEAN)"
    return f"{', '.join(cols)}, ({' + '.join(parts)}) / {total}::DOUBLE AS score, {verdict} AS passed"


@query("g1_string_check", with_ctes(
    "SELECT conv_id, turn, " + _graded_sql(
        {"same": "actual_output = expected_output", "differs": "actual_output <> input",
         "holds": "contains(expected_output, actual_output)",
         "loose": "contains(lower('[' || actual_output || ']'), lower(expected_output))"},
        {"same": 1.0, "differs": 0.0, "holds": 0.5, "loose": 0.5},
        {"same": 0.7, "differs": 0.7, "holds": None, "loose": 1.0}) + " FROM v_samples", SQL_SAMPLES))
def g1(spark, sf):
    out, want = "{{ sample.output_text }}", "{{ item.expected_output }}"
    definitions = [
        {"type": "string_check", "name": "same", "input_value": out, "reference_value": want},
        {"type": "string_check", "name": "differs", "operation": "not_equals", "input_value": out,
         "reference_value": "{{ item.input }}", "weight": 0.0},
        {"type": "string_check", "name": "holds", "operation": "contains", "input_value": want,
         "reference_value": out, "threshold": None, "weight": 0.5},
        {"type": "string_check", "name": "loose", "operation": "contains_ignore_case",
         "input_value": f"[{out}]", "reference_value": want, "threshold": 1.0, "weight": 0.5},
    ]
    return _verdicts(views.samples(spark, sf), definitions, _SAMPLE_ITEM, ["conv_id", "turn"])


@query("g1_unknown_operation", """
SELECT event_id, 0.0::DOUBLE AS odd_score, false AS odd_passed, 'Unknown operation: resembles' AS odd_error,
  0.0::DOUBLE AS score, false AS passed FROM events""")
def g1_unknown(spark, sf):
    rows = views.results(spark, sf).drop("error", "score", "passed")
    return _verdicts(rows, [{"type": "string_check", "name": "odd", "operation": "resembles"}],
                     graders.Context(), ["event_id"], "error")


@query("g7_exact_match", with_ctes(
    "SELECT conv_id, turn, " + _graded_sql(
        {"strict": r"regexp_replace(expected_output, '^\s+|\s+$', '', 'g') = regexp_replace(actual_output, '^\s+|\s+$', '', 'g')",
         "folded": r"lower(regexp_replace(expected_output, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(actual_output, '^\s+|\s+$', '', 'g'))"},
        {"strict": 1.0, "folded": 1.0}, {"strict": 0.7, "folded": 0.7}) + " FROM v_samples", SQL_SAMPLES))
def g7(spark, sf):
    definitions = [
        {"type": "exact_match", "name": "strict"},
        {"type": "exact_match", "name": "folded", "case_sensitive": False},
    ]
    return _verdicts(views.samples(spark, sf), definitions, _SAMPLE_ITEM, ["conv_id", "turn"])


@graders.register_grader("query_length_ratio")
def _length_ratio(definition, context, slot):
    """An added grader type: shorter by longer length of output and expectation."""
    a, b = F.char_length(F.trim(F.col(context.actual))), F.char_length(F.trim(F.col(context.expected)))
    ratio = F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))
    verdict = graders.verdict_struct(definition, F.coalesce(ratio, F.lit(0.0)))
    return graders.Grader(definition["name"], float(definition.get("weight", 1.0)), lambda df: df, verdict)


@query("j1_grader_registry", """
SELECT event_id, CASE WHEN n > 8 THEN 8.0 / n ELSE n / 8::DOUBLE END AS score, (CASE WHEN n > 8 THEN 8.0 / n ELSE n / 8::DOUBLE END) >= 0.9 AS passed
FROM (SELECT event_id, length(event_type) AS n FROM events)""")
def j1(spark, sf):
    """Events graded by a type that is not built in, found by its name."""
    rows = views.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("actual_output"), F.lit("purchase").alias("expected_output"))
    built = graders.build_graders([{"type": "query_length_ratio", "name": "ratio", "threshold": 0.9}], graders.Context())
    return graders.grade(rows, built).select("event_id", "score", "passed")


@query("g8_pattern_match", "SELECT doc_id, " + _graded_sql(
    {"mail": r"regexp_matches(text, '[a-z]+@[a-z]+\.[a-z]+')", "lang": "contains(text, lang)"},
    {"mail": 1.0, "lang": 0.5}, {"mail": 0.7, "lang": 0.7}) + " FROM documents")
def g8(spark, sf):
    definitions = [
        {"type": "pattern_match", "name": "mail", "pattern": r"[a-z]+@[a-z]+\.[a-z]+"},
        {"type": "pattern_match", "name": "lang", "weight": 0.5},
    ]
    context = graders.Context(expected="lang", actual="text")
    return _verdicts(views.table(spark, sf, "documents"), definitions, context, ["doc_id"])


# --- JSON ------------------------------------------------------------------------


@query("g2_json_field_path", """
SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = user_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k_score,
  coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) = user_id, false) AS k_passed, CAST(NULL AS VARCHAR) AS k_error,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = user_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
  coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) = user_id, false) AS passed FROM events""")
def g2(spark, sf):
    rows = views.table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("expected_output"), F.col("props").alias("actual_output"))
    definitions = [{"type": "json_field", "name": "k", "field_name": "k", "path": "$.k"}]
    return _verdicts(rows, definitions, graders.Context(), ["event_id"], "error")


@query("g2_json_field_anywhere", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS flag_score, l_returnflag = 'R' AS flag_passed,
  0.0::DOUBLE AS none_score, CAST(NULL AS BOOLEAN) AS none_passed,
  CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, l_returnflag = 'R' AS passed FROM lineitem""")
def g2_any(spark, sf):
    line = views.table(spark, sf, "lineitem")
    doc = F.struct(
        F.struct(F.array(F.struct(F.col("l_returnflag").alias("flag"))).alias("parts")).alias("order"),
        F.struct(F.col("l_linestatus").alias("flag")).alias("later"))
    rows = line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.lit(" r ").alias("expected_output"), F.to_json(doc).alias("actual_output"))
    definitions = [
        {"type": "json_field", "name": "flag", "field_name": "flag"},
        {"type": "json_field", "name": "none", "field_name": "absent", "threshold": None},
    ]
    return _verdicts(rows, definitions, graders.Context(), rows.columns[:6])


_SCHEMA = {
    "type": "object",
    "properties": {
        "id": {"type": "integer", "minimum": 0},
        "status": {"type": "string", "enum": ["O", "P"]},
        "qty": {"type": "number", "maximum": 45},
        "tags": {"type": "array", "items": {"type": "string", "maxLength": 4}, "maxItems": 2},
    },
    "required": ["id", "status", "qty"],
    "additionalProperties": False,
}


def _outputs(spark, sf):
    """Model outputs as JSON text with every kind of fault."""
    line = views.table(spark, sf, "lineitem")
    number, qty = F.col("l_linenumber"), F.col("l_quantity")
    doc = F.struct(
        F.when(number != 3, F.col("l_orderkey")).alias("id"),
        F.col("l_linestatus").alias("status"),
        qty.alias("qty"),
        F.when(number == 5, F.array(F.lit("a"), F.lit("b"), F.lit("c")))
        .when(number == 6, F.array(F.lit("ok"), F.col("l_returnflag"), ).cast("array<string>"))
        .when(number == 2, F.array(F.lit("ok"), F.lit("lengthy"))).alias("tags"),
        F.when(number == 7, F.lit(1)).alias("more"))
    text = F.when(number == 4, F.concat(F.lit("no json "), F.col("l_returnflag"))).otherwise(F.to_json(doc))
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        text.alias("actual_output"))


@query("g3_json_schema", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, fault IS NULL AS valid,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN fault IS NOT NULL THEN fault END AS violation
FROM (SELECT *, CASE WHEN l_linenumber = 4 THEN 'unparsed'
  ELSE list_min(list_filter([
    CASE WHEN l_linenumber = 7 THEN '$ $.additionalProperties Additional properties are not allowed (''more'' was unexpected)' END,
    CASE WHEN l_linenumber = 3 THEN '$ $.required ''id'' is a required property' END,
    CASE WHEN l_quantity > 45 THEN '$.qty $.properties.qty.maximum ' || l_quantity::BIGINT || ' is greater than the maximum of 45' END,
    CASE WHEN l_linestatus = 'F' THEN '$.status $.properties.status.enum ''F'' is not one of [''O'', ''P'']' END,
    CASE WHEN l_linenumber = 5 THEN '$.tags $.properties.tags.maxItems ["a","b","c"] is too long' END,
    CASE WHEN l_linenumber = 2 THEN '$.tags[1] $.properties.tags.items.maxLength ''lengthy'' is too long' END
  ], lambda x: x IS NOT NULL)) END AS fault FROM lineitem)""")
def g3(spark, sf):
    checked = schema_check.validate(_outputs(spark, sf), "actual_output", _SCHEMA, "check")
    return checked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "check.valid",
        F.when(
            F.col("check.validation_message").isNotNull(),
            F.concat_ws(" ", "check.validation_path", "check.schema_path", "check.validation_message"),
        ).alias("violation"))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _first_faults(rows, schema):
    checked = schema_check.validate(rows, "actual_output", schema, "check")
    fault = F.concat_ws(" ", "check.validation_path", "check.schema_path", "check.validation_message")
    return checked.select(*_LINE, F.when(F.col("check.validation_message").isNotNull(), fault).alias("violation"))


def _faults_sql(*faults, unparsed="l_linenumber = 4"):
    """The first of the faults of a line, each as a condition and a text."""
    listed = ", ".join(f"CASE WHEN {condition} THEN {text} END" for condition, text in faults)
    return f"""SELECT {", ".join(_LINE)}, CASE WHEN NOT ({unparsed}) THEN list_min(list_filter([{listed}], lambda x: x IS NOT NULL)) END
      AS violation FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty FROM lineitem)"""


_NONE_HOLDS = "is not valid under any of the given schemas"


@query("g3_any_of", _faults_sql(
    ("l_linenumber = 3 AND l_linestatus = 'F'", f"""'$ $.anyOf {{"qty":' || qty || ',"status":"F"}} {_NONE_HOLDS}'"""),
    ("l_quantity > 10 AND l_quantity < 40", f"'$.qty $.properties.qty.anyOf ' || qty || ' {_NONE_HOLDS}'"),
    ("l_linenumber = 2", f"""'$.tags $.properties.tags.anyOf ["ok","lengthy"] {_NONE_HOLDS}'""")))
def g3_any_of(spark, sf):
    return _first_faults(_outputs(spark, sf), {
        "anyOf": [{"required": ["id"]}, {"properties": {"status": {"const": "O"}}}],
        "properties": {
            "qty": {"anyOf": [{"maximum": 10}, {"minimum": 40}]},
            "tags": {"anyOf": [{"maxItems": 2, "items": {"maxLength": 4}}, {"minItems": 3}]},
        },
    })


@query("g3_one_of", _faults_sql(
    ("l_quantity % 2 <> 0 AND l_quantity % 3 <> 0", f"'$.qty $.properties.qty.oneOf ' || qty || ' {_NONE_HOLDS}'"),
    ("l_quantity % 6 = 0", "'$.qty $.properties.qty.oneOf ' || qty || ' is valid under each of {''multipleOf'': 3}, {''multipleOf'': 2}'")))
def g3_one_of(spark, sf):
    return _first_faults(_outputs(spark, sf), {"properties": {"qty": {"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}}})


@query("g3_all_of", _faults_sql(
    ("l_linenumber = 3", "'$ $.allOf[0].required ''id'' is a required property'"),
    ("l_linenumber NOT IN (3, 7)", "'$ $.allOf[0].required ''more'' is a required property'"),
    ("l_quantity < 5", "'$.qty $.allOf[1].properties.qty.allOf[0].minimum ' || qty || ' is less than the minimum of 5'"),
    ("l_quantity > 40", "'$.qty $.allOf[1].properties.qty.allOf[1].maximum ' || qty || ' is greater than the maximum of 40'"),
    ("l_linestatus = 'F'", "'$.status $.allOf[2].properties.status.const ''O'' was expected'")))
def g3_all_of(spark, sf):
    return _first_faults(_outputs(spark, sf), {"allOf": [
        {"required": ["id", "more"]},
        {"properties": {"qty": {"allOf": [{"minimum": 5}, {"maximum": 40}]}}},
        {"properties": {"status": {"const": "O"}}},
    ]})


@query("g3_not", _faults_sql(
    ("l_linestatus = 'F'", "'$.status $.properties.status.not ''F'' should not be valid under {''const'': ''F''}'"),
    ("l_linenumber = 5", """'$.tags $.properties.tags.not ["a","b","c"] should not be valid under {''contains'': {''const'': ''a''}}'""")))
def g3_not(spark, sf):
    return _first_faults(_outputs(spark, sf), {
        "properties": {"status": {"not": {"const": "F"}}, "tags": {"not": {"contains": {"const": "a"}}}}})


@query("g3_ref", _faults_sql(
    ("l_quantity > 45", "'$.qty $.properties.qty.maximum ' || qty || ' is greater than the maximum of 45'"),
    ("l_linestatus = 'F'", "'$.status $.properties.status.enum ''F'' is not one of [''O'', ''P'']'"),
    ("l_linenumber = 2", "'$.tags[1] $.properties.tags.items.maxLength ''lengthy'' is too long'")))
def g3_ref(spark, sf):
    return _first_faults(_outputs(spark, sf), {
        "$defs": {
            "code": {"enum": ["O", "P"]}, "amount": {"type": "number", "maximum": 45},
            "list": {"items": {"$ref": "#/$defs/word"}}, "word": {"maxLength": 4},
        },
        "properties": {"status": {"$ref": "#/$defs/code"}, "qty": {"$ref": "#/$defs/amount"}, "tags": {"$ref": "#/$defs/list"}},
    })


@query("g3_recursive", _faults_sql(
    ("l_partkey % 10 = 9", "'$.kids[0].kids[0].v $.properties.kids.items.properties.kids.items.properties.v.not -9 should not be valid under {''const'': -9}'"),
    ("l_quantity > 45", "'$.kids[0].v $.properties.kids.items.properties.v.maximum ' || qty || ' is greater than the maximum of 45'"),
    unparsed="false"))
def g3_recursive(spark, sf):
    """Trees of line number, quantity and part, checked by a schema that refers to itself."""
    line = views.table(spark, sf, "lineitem")
    leaf = F.struct((-(F.col("l_partkey") % 10)).alias("v"))
    branch = F.struct(F.col("l_quantity").alias("v"), F.array(leaf).alias("kids"))
    tree = F.struct(F.col("l_linenumber").alias("v"), F.array(branch).alias("kids"))
    node = {
        "properties": {"v": {"maximum": 45, "not": {"const": -9}}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}},
        "required": ["v"],
    }
    return _first_faults(line.select(*_LINE, F.to_json(tree).alias("actual_output")), {"$defs": {"node": node}, "$ref": "#/$defs/node"})


@query("g3_violation_counts", """
SELECT path, schema_path, count(*) AS violations FROM (
  SELECT '$' AS path, '$.additionalProperties' AS schema_path FROM lineitem WHERE l_linenumber = 7
  UNION ALL SELECT '$', '$.required' FROM lineitem WHERE l_linenumber = 3
  UNION ALL SELECT '$.qty', '$.properties.qty.maximum' FROM lineitem WHERE l_quantity > 45 AND l_linenumber <> 4
  UNION ALL SELECT '$.status', '$.properties.status.enum' FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <> 4
  UNION ALL SELECT '$.tags', '$.properties.tags.maxItems' FROM lineitem WHERE l_linenumber = 5
  UNION ALL SELECT '$.tags[]', '$.properties.tags.items.maxLength' FROM lineitem WHERE l_linenumber = 2
) GROUP BY ALL""")
def g3_counts(spark, sf):
    return schema_check.violation_counts(_outputs(spark, sf), "actual_output", _SCHEMA)


@query("g3a_parse_messages", """
SELECT l_returnflag, count(*) AS outputs, 'The model output was not valid JSON, so the JSON schema grader could not validate it. '
  || 'JSON parsing failed at line 1, column 1: Expecting value. The first non-whitespace character was ''n''. '
  || 'Output preview: ''no json ' || l_returnflag || '''' AS error
FROM lineitem WHERE l_linenumber = 4 GROUP BY ALL""")
def g3a(spark, sf):
    checked = schema_check.validate(_outputs(spark, sf), "actual_output", _SCHEMA, "check")
    flag = F.regexp_extract("actual_output", "^no json (.)$", 1)
    return checked.filter(F.col("check.error") != schema_check.FAILED).groupBy(
        flag.alias("l_returnflag"), F.col("check.error").alias("error")
    ).agg(F.count(F.lit(1)).alias("outputs"))


# --- similarity --------------------------------------------------------------------


@query("g4_semantic_similarity", """
SELECT a.vec_id, s AS near_score, coalesce(s, 0.0) >= 0.8 AS near_passed, CASE WHEN s IS NULL THEN 'no embedding' END AS near_error,
  coalesce(s, 0.0) AS score, coalesce(s, 0.0) >= 0.8 AS passed
FROM (SELECT a.vec_id, CAST(printf('%.4f', list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
       * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS DOUBLE) AS s
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1) a""")
def g4(spark, sf):
    definitions = [{"type": "semantic_similarity", "name": "near", "vectors": ("expected", "actual")}]
    return _verdicts(views.vector_pairs(spark, sf), definitions, graders.Context(), ["vec_id"], "error")


def bucket_embedder(texts: list[str]) -> list[list[float]]:
    """Deterministic stand-in for an embedding model: vowel counts."""
    return [[float(t.lower().count(v)) for v in "aeiou"] for t in texts]


def _vowels(col: str) -> str:
    counts = ", ".join(
        f"(length({col}) - length(replace(replace({col}, '{v}', ''), '{v.upper()}', '')))::DOUBLE" for v in "aeiou")
    return f"[{counts}]"


@query("j5_embedded_similarity", with_ctes(
    f"""SELECT conv_id, turn, CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE CAST(printf('%.4f', dot / (na * nb)) AS DOUBLE) END AS near_score,
  CASE WHEN na = 0 OR nb = 0 THEN false ELSE CAST(printf('%.4f', dot / (na * nb)) AS DOUBLE) >= 0.8 END AS near_passed,
  CASE WHEN na = 0 OR nb = 0 THEN 0.0::DOUBLE ELSE CAST(printf('%.4f', dot / (na * nb)) AS DOUBLE) END AS score,
  CASE WHEN na = 0 OR nb = 0 THEN false ELSE CAST(printf('%.4f', dot / (na * nb)) AS DOUBLE) >= 0.8 END AS passed
FROM (SELECT conv_id, turn, list_inner_product(a, b) AS dot, sqrt(list_inner_product(a, a)) AS na, sqrt(list_inner_product(b, b)) AS nb
  FROM (SELECT conv_id, turn, {_vowels("input")} AS a, {_vowels("expected_output")} AS b FROM v_samples))""", SQL_SAMPLES))
def j5(spark, sf):
    definitions = [{"type": "semantic_similarity", "name": "near", "embedder": bucket_embedder,
                    "spread_by": ["conv_id", "turn"]}]
    rows = views.samples(spark, sf).select("conv_id", "turn", "input", "expected_output")
    context = graders.Context(expected="expected_output", actual="input")
    return _verdicts(rows, definitions, context, ["conv_id", "turn"])


# --- user code ------------------------------------------------------------------------

_SOURCE = '''
import math

def grade(sample, item):
    if item["event_type"] == "signup":
        return item["missing"]
    return math.sqrt(len(sample["output_text"])) / 2 - 0.25 * (item["event_type"] == "click")
'''


@query("g5_python_grader", """
SELECT event_id, s AS custom_score, s >= 0.7 AS custom_passed,
  CASE WHEN event_type = 'signup' THEN 'grade() raised: ''missing''' END AS custom_error, s AS score, s >= 0.7 AS passed
FROM (SELECT event_id, event_type, CASE WHEN event_type = 'signup' THEN 0.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, sqrt(length(props)) / 2 - CASE WHEN event_type = 'click' THEN 0.25 ELSE 0 END)) END AS s FROM events)""")
def g5(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", "event_type", F.col("props").alias("actual_output"))
    context = graders.Context(item={"event_type": "event_type"})
    return _verdicts(rows, [{"type": "python", "name": "custom", "source_code": _SOURCE}], context,
                     ["event_id"], "error")


# --- judge ------------------------------------------------------------------------------


@query("s7_judge_prompts", """
SELECT p_partkey, 'Does "' || p_type || '" match "' || p_name || '"? {keep}' AS filled,
  'Rate it.' || chr(10) || chr(10) || 'Expected output:' || chr(10) || p_name || chr(10) || chr(10) || 'Actual output:' || chr(10) || p_type AS appended
FROM part""")
def s7(spark, sf):
    want, got = F.col("p_name"), F.col("p_type")
    return views.table(spark, sf, "part").select(
        "p_partkey",
        judge_prompt('Does "{actual}" match "{expected}"? {keep}', want, got).alias("filled"),
        judge_prompt("Rate it.", want, got).alias("appended"))


@query("s8_judge_replies", """
SELECT event_id, CASE event_type WHEN 'error' THEN 0.0 WHEN 'signup' THEN 0.0 ELSE value / 50 END AS score,
  CASE event_type WHEN 'error' THEN 'Failed to parse grader response: sorry, ' || props
    WHEN 'click' THEN '' ELSE 'because ' || user_id END AS reasoning FROM events""")
def s8(spark, sf):
    kind = F.col("event_type")
    reply = F.when(kind == "error", F.concat(F.lit("sorry, "), "props")).otherwise(F.to_json(F.struct(
        F.when(kind != "signup", F.col("value") / 50).alias("score"),
        F.when(kind != "click", F.concat(F.lit("because "), F.col("user_id").cast("string"))).alias("reasoning"))))
    return views.table(spark, sf, "events").select(
        "event_id", graders.parse_judge_reply(reply).alias("r")).select("event_id", "r.score", "r.reasoning")


def stub_judge(request: dict) -> inference.Reply:
    """Scores by the share of the expected text in the prompt; refuses some prompts."""
    prompt = request["input"][1]["content"]
    expected, _, actual = prompt.partition(" | ")
    if expected == "signup":
        raise RuntimeError("rate limited")
    if expected == "error":
        return inference.Reply("no idea", 1, 1, 5)
    score = 0.9 if expected == actual else 0.25
    return inference.Reply(f'{{"score": {score}, "reasoning": "{actual}"}}', 3, 2, 7)


@query("g6_prompt_grader", """
SELECT event_id, s AS judge_score, coalesce(s, 0.0) >= 0.7 AS judge_passed,
  CASE WHEN want = 'signup' THEN 'rate limited' END AS judge_error,
  CASE WHEN want = 'signup' THEN NULL WHEN want = 'error' THEN 'Failed to parse grader response: no idea' ELSE got END AS judge_reasoning,
  coalesce(s, 0.0) AS score, coalesce(s, 0.0) >= 0.7 AS passed
FROM (SELECT event_id, want, got, CASE WHEN want = 'signup' THEN NULL WHEN want = 'error' THEN 0.0::DOUBLE
    WHEN want = got THEN 0.9::DOUBLE ELSE 0.25::DOUBLE END AS s
  FROM (SELECT event_id, event_type AS want, CASE WHEN value >= 50 THEN 'purchase' ELSE 'view' END AS got FROM events))""")
def g6(spark, sf):
    rows = views.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("expected_output"),
        F.when(F.col("value") >= 50, "purchase").otherwise("view").alias("actual_output"))
    definitions = [{"type": "prompt", "name": "judge", "prompt": "{expected} | {actual}",
                    "provider": stub_judge, "model": "judge-small"}]
    return _verdicts(rows, definitions, graders.Context(), ["event_id"], "error", "reasoning")


# --- all graders, generation --------------------------------------------------------------


@query("g9_all_graders", with_ctes(
    """SELECT conv_id, turn, 'folded,length,same' AS graders,
  CASE WHEN actual_output = expected_output THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same_score,
  least(1.0::DOUBLE, length(actual_output) / 200::DOUBLE) AS length_score,
  (CASE WHEN actual_output = expected_output THEN 1.0 ELSE 0.0 END + 0.5 * CASE WHEN lower(actual_output) = lower(expected_output) THEN 1.0 ELSE 0.0 END) / 1.5::DOUBLE AS score,
  actual_output = expected_output AND lower(actual_output) = lower(expected_output) AS passed
FROM v_samples""", SQL_SAMPLES))
def g9(spark, sf):
    definitions = [
        {"type": "string_check", "name": "same", "input_value": "{{ sample.output_text }}",
         "reference_value": "{{ item.expected_output }}"},
        {"type": "exact_match", "name": "folded", "case_sensitive": False, "weight": 0.5},
        {"type": "python", "name": "length", "weight": 0.0, "threshold": None,
         "source_code": "def grade(sample, item):\n    return len(sample['output_text']) / 200"},
    ]
    graded = graders.grade(
        views.samples(spark, sf), graders.build_graders(definitions, _SAMPLE_ITEM))
    return graded.select(
        "conv_id", "turn",
        F.array_join(F.array_sort(F.map_keys("details")), ",").alias("graders"),
        F.col("details")["same"]["score"].alias("same_score"),
        F.col("details")["length"]["score"].alias("length_score"),
        "score", "passed")


class EchoProvider:
    """Answers in capitals; refuses empty questions and takes a fixed time."""

    def __call__(self, request: dict) -> inference.Reply:
        prompt = request["input"][1]["content"]
        if prompt.startswith("error"):
            raise ValueError("model refused: error")
        return inference.Reply(prompt.upper(), len(prompt), len(request["model"]), 12)


@query("j3_batch_inference", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN upper(event_type) || ' ' || upper(props) END AS actual_output,
  CASE WHEN event_type <> 'error' THEN 12 END AS latency_ms,
  CASE WHEN event_type <> 'error' THEN CAST(length(event_type) + 1 + length(props) AS INTEGER) END AS input_tokens,
  CASE WHEN event_type <> 'error' THEN 10 END AS output_tokens,
  CASE WHEN event_type = 'error' THEN 'model refused: error' END AS error FROM events""")
def j3(spark, sf):
    work = views.table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("input"))
    answered = inference.evaluate_rows(
        work, EchoProvider(), system_prompt=F.lit("Echo"), model=F.lit("echo-model"))
    return answered.drop("input")


@query("g11_row_errors", """
SELECT event_type, count(*) AS rows,
  count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type <> 'error') AS graded
FROM events GROUP BY 1""")
def g11(spark, sf):
    work = views.table(spark, sf, "events").select(
        "event_type", F.concat_ws(" ", "event_type", "props").alias("input"), F.lit("CLICK").alias("expected_output"))
    answered = inference.evaluate_rows(
        work, EchoProvider(), system_prompt=F.lit("Echo"), model=F.lit("echo-model"))
    graded = graders.grade(answered, graders.build_graders(
        [{"type": "pattern_match", "name": "kind"}], graders.Context()))
    return graded.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(summary.has_error()).alias("errors"),
        F.count("details").alias("graded"))


@query("j4_request_assembly", """
SELECT p_partkey, json_extract_string(request, '$.model') AS model, json_extract_string(request, '$.temperature') AS temperature,
  json_extract_string(request, '$.tools[0].type') AS tool, json_extract_string(request, '$.tool_choice') AS tool_choice,
  json_extract_string(request, '$.text.format.name') AS format_name, json_extract_string(request, '$.input[1].content') AS content,
  json_extract_string(request, '$.reasoning.effort') AS effort
FROM (SELECT p_partkey, json_object('model', CASE WHEN p_size % 2 = 0 THEN 'o3-mini' ELSE 'plain-model' END,
  'temperature', CASE WHEN p_size % 2 <> 0 AND p_size % 5 <> 0 THEN 0.25 END,
  'reasoning', CASE WHEN p_size % 5 = 0 THEN json_object('effort', 'low') END,
  'tools', CASE WHEN p_size % 3 = 0 THEN json_array(json_object('type', 'shell')) END,
  'tool_choice', CASE WHEN p_size % 3 = 0 THEN 'required' END,
  'text', json_object('format', json_object('type', 'json_schema', 'name', regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g'))),
  'input', json_array(json_object('content', 'sys'), json_object('content', p_type))) AS request FROM part)""")
def j4(spark, sf):
    size = F.col("p_size")
    request = inference.request_column(
        model=F.when(size % 2 == 0, "o3-mini").otherwise("plain-model"),
        system_prompt=F.lit("sys"),
        user_input=F.col("p_type"),
        temperature=F.lit(0.25),
        tools=F.when(size % 3 == 0, F.array(F.lit("shell"), F.lit("unknown"))).otherwise(F.array().cast("array<string>")),
        tool_options=F.create_map(F.lit("tool_choice"), F.lit("required")),
        reasoning_effort=F.when(size % 5 == 0, "low"),
        format_type=F.lit("json_schema"),
        format_label=F.col("p_name"))
    part = views.table(spark, sf, "part").select("p_partkey", request.alias("request"))
    at = lambda path: F.get_json_object("request", path)
    return part.select(
        "p_partkey", at("$.model").alias("model"), at("$.temperature").alias("temperature"),
        at("$.tools[0].type").alias("tool"), at("$.tool_choice").alias("tool_choice"),
        at("$.text.format.name").alias("format_name"), at("$.input[1].content").alias("content"),
        at("$.reasoning.effort").alias("effort"))


@query("j4_whole_format", """
SELECT p_partkey, 'json_schema' AS kind, regexp_replace(p_name, '[^a-zA-Z0-9_-]', '_', 'g') AS name, 'true' AS strict,
  'integer' AS size_type, CAST(p_size AS VARCHAR) AS most, CASE WHEN p_size % 2 = 0 THEN 'high' END AS effort,
  CASE WHEN p_size % 2 = 0 THEN 'auto' END AS summary FROM part""")
def j4_whole(spark, sf):
    shape = F.to_json(F.struct(
        F.lit("json_schema").alias("type"), F.col("p_name").alias("name"), F.lit(True).alias("strict"),
        F.struct(F.struct(F.struct(F.lit("integer").alias("type"), F.col("p_size").alias("maximum")).alias("size")).alias(
            "properties")).alias("schema")))
    request = inference.request_column(
        model=F.lit("plain-model"), system_prompt=F.lit("sys"), user_input=F.col("p_type"), response_format=shape,
        reasoning=F.when(F.col("p_size") % 2 == 0, F.lit('{"effort": "high", "summary": "auto"}')))
    part = views.table(spark, sf, "part").select("p_partkey", request.alias("request"))
    at = lambda path: F.get_json_object("request", path)
    return part.select(
        "p_partkey", at("$.text.format.type").alias("kind"), at("$.text.format.name").alias("name"),
        at("$.text.format.strict").alias("strict"), at("$.text.format.schema.properties.size.type").alias("size_type"),
        at("$.text.format.schema.properties.size.maximum").alias("most"), at("$.reasoning.effort").alias("effort"),
        at("$.reasoning.summary").alias("summary"))


@query("s12_reply_text", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE l_returnflag || chr(10) || l_linestatus END AS reply
FROM lineitem""")
def s12(spark, sf):
    number = F.col("l_linenumber")

    def part(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    content = F.array(part("output_text", F.col("l_returnflag")), part("refusal", F.lit("no")),
                      part("output_text", F.col("l_linestatus")))
    message = F.struct(
        F.when(number % 3 == 0, "tool_call").otherwise("message").alias("type"),
        F.when(number % 3 == 1, F.slice(content, 1, 2)).otherwise(content).alias("content"))
    other = F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"))
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        inference.reply_text(F.array(other, message)).alias("reply"))
