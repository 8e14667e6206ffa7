"""JSON Schema checks of text columns: parse messages, violations, the first one by path.

Schemas compile to columns over VARIANT (``schema_rules``), without a Python worker. A schema
that refers to itself has no fixed depth; its documents are walked in Arrow batches
(``schema_walk``). Known keywords that neither supports are an error when the check is built;
formats are annotations, and unknown keywords hold, as the standard has it.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators import schema_walk
from gradeloom.operators.schema_rules import VIOLATION, Compiler, Place, Stages, check_schema, is_recursive

# Fixed values of the parse-failure message.
PARSE_PREFIX = "The model output was not valid JSON, so the JSON schema grader could not validate it. "
FAILED = "JSON schema validation failed"
PREVIEW_LIMIT = 160


def violations(schema: dict, value: Column) -> Column:
    """Array of ``struct(path, schema_path, n, message)`` for a VARIANT column, with NULLs
    for rules that hold (drop them after ``explode``)."""
    check_schema(schema)
    if is_recursive(schema):
        return _walked(schema)(F.to_json(value))
    return Compiler(schema).every(schema, Place(value, "$"))


def _walked(schema: dict):
    """Violations of JSON text under a recursive schema."""

    @F.arrow_udf(f"array<{VIOLATION}>")
    def walk(texts: pa.Array) -> pa.Array:
        check = schema_walk.Walk(schema)
        found = [None if t is None else check.violations(json.loads(t)) for t in texts.to_pylist()]
        kind = [("path", pa.string()), ("schema_path", pa.string()), ("n", pa.int32()), ("message", pa.string())]
        return pa.array(found, pa.list_(pa.struct(kind)))

    return walk


def _add_first(df: DataFrame, schema: dict, doc: str, out: str) -> tuple[DataFrame, list[str]]:
    """Add the violation with the smallest path, then rule; NULL for a valid document. Also the columns on the way.

    ``least`` skips NULL, so nothing but the checks themselves is evaluated.
    """
    if is_recursive(schema):
        return df.withColumn(out, F.array_min(_walked(schema)(F.to_json(doc)))), []
    stages = Stages(f"{out}_")
    single, listed = Compiler(schema).wrong(schema, Place(F.col(doc), "$", stages))
    found = [c.cast(VIOLATION) for c in single]
    found += [F.array_min(m.cast(f"array<{VIOLATION}>")) for m in listed]
    none = F.lit(None).cast(VIOLATION)
    return stages.apply(df).withColumn(out, F.least(*found, none, none)), stages.names()


_EXPLAINED = T.StructType([T.StructField("message", T.StringType()), T.StructField("document", T.StringType())])


def _explanation(text: str) -> tuple[str | None, str | None]:
    try:
        return None, json.dumps(json.loads(text), ensure_ascii=False)
    except json.JSONDecodeError as exc:
        where = f"JSON parsing failed at line {exc.lineno}, column {exc.colno}: {exc.msg}."
    words = " ".join(text.split())
    if not words:
        return f"{PARSE_PREFIX}{where} The response was empty or whitespace only. Output preview: (empty response)", None
    head = words if len(words) <= PREVIEW_LIMIT else words[:PREVIEW_LIMIT].rstrip() + "..."
    token = re.search(r"\S", text).group()
    first = f" The first non-whitespace character was {token!r}."
    return f"{PARSE_PREFIX}{where}{first} Output preview: {head!r}", None


@F.arrow_udf(_EXPLAINED)
def explain_unparsed(texts: pa.Array) -> pa.Array:
    """Why a text is no JSON. NULL input (text that parsed) costs nothing.

    Text that only Spark's stricter parser refuses (a repeated key) comes back
    as an equal document instead.
    """
    kind = pa.struct([("message", pa.string()), ("document", pa.string())])
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), kind)
    found = {i: _explanation(t) for i, t in enumerate(texts.to_pylist()) if t is not None}
    columns = [pa.array([found[i][k] if i in found else None for i in range(len(texts))], pa.string()) for k in range(2)]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def validate(df: DataFrame, column: str, schema: dict, out: str) -> DataFrame:
    """Add struct ``out`` (valid, error, first violation by path) for JSON text in ``column``."""
    check_schema(schema)
    doc, broken, found = f"_{out}_doc", f"_{out}_broken", f"_{out}_found"
    text = F.coalesce(F.col(column), F.lit(""))
    df = df.withColumn(doc, F.try_parse_json(text))
    # Declared non-deterministic only to keep later filters from repeating the calls.
    explain = explain_unparsed.asNondeterministic()
    df = df.withColumn(broken, explain(F.when(F.col(doc).isNull(), text)))
    df = df.withColumn(doc, F.coalesce(F.col(doc), F.try_parse_json(F.col(broken)["document"])))
    df, staged = _add_first(df, schema, doc, found)
    unparsed = F.col(doc).isNull()
    first = F.col(found)
    return df.withColumn(
        out,
        F.struct(
            (~unparsed & first.isNull()).alias("valid"),
            F.when(unparsed, F.col(broken)["message"]).when(first.isNotNull(), FAILED).alias("error"),
            F.when(~unparsed, first["message"]).alias("validation_message"),
            F.when(~unparsed, first["path"]).alias("validation_path"),
            F.when(~unparsed, first["schema_path"]).alias("schema_path"),
        ),
    ).drop(doc, broken, found, *staged)


def violation_counts(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """How often each rule is broken, over all violations of all rows."""
    parsed = df.select(F.try_parse_json(column).alias("_doc")).filter(F.col("_doc").isNotNull())
    each = parsed.select(F.explode(violations(schema, F.col("_doc"))).alias("v")).filter("v IS NOT NULL")
    general = F.regexp_replace(F.col("v.path"), r"\[\d+\]", "[]")
    return each.groupBy(general.alias("path"), F.col("v.schema_path").alias("schema_path")).agg(
        F.count(F.lit(1)).alias("violations")
    )
