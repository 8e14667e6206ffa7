"""Graders: each turns (expected, actual, row) into a verdict column.

A grader definition is a dict with ``type``, ``name``, ``weight``, ``threshold``
and type-specific keys. ``build_graders`` checks the definitions once on the
driver; ``grade`` adds verdicts, the combined score and the combined pass flag
to a DataFrame. Native graders are plain expressions; only user code, the
schema-less field search and model calls use Python workers.
"""

from __future__ import annotations

import builtins
import importlib.metadata
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.numbers import exact_round
from gradeloom.functions.templates import judge_prompt, template_column
from gradeloom.functions.text import strip
from gradeloom.operators.browse import DEFAULT_THRESHOLD, DEFAULT_THRESHOLDS
from gradeloom.operators.schema_check import validate

ENTRY_POINTS = "gradeloom.graders"

# Operations of the string check.
STRING_OPERATIONS = ("equals", "not_equals", "contains", "contains_ignore_case")

# Builtins and modules user grading code may use.
ALLOWED_BUILTINS = (
    "abs", "all", "any", "bool", "dict", "enumerate", "filter", "float", "frozenset", "int", "isinstance", "len",
    "list", "map", "max", "min", "print", "range", "reversed", "round", "set", "sorted", "str", "sum", "tuple",
    "type", "zip",
)
ALLOWED_MODULES = {"re": re, "json": json, "math": math}

# Fixed value: instruction of the judge.
JUDGE_INSTRUCTION = (
    "You are an evaluation grader. You will be given an expected output and an actual output. "
    "Use the evaluation criteria provided by the user to score the actual output. "
    'Respond with ONLY a JSON object: {"score": <float 0.0-1.0>, "reasoning": "<brief explanation>"}'
)


@dataclass(frozen=True)
class Context:
    """Which columns hold the texts and the row fields."""

    expected: str = "expected_output"
    actual: str = "actual_output"
    item: dict[str, str] = field(default_factory=dict)  # field name -> column name
    item_map: str | None = None  # or one map<string,string> column

    def fields(self) -> dict[str, Column] | Column:
        if self.item_map:
            return F.col(self.item_map)
        return {name: F.col(column) for name, column in self.item.items()}


@dataclass(frozen=True)
class FieldSearch:
    """First field ``name`` anywhere in the JSON text of ``column``; the finding goes to ``slot``."""

    column: str
    name: str
    slot: str


@dataclass(frozen=True)
class Grader:
    """A named verdict: ``prepare`` adds helper columns, ``verdict`` reads them."""

    name: str
    weight: float
    prepare: Callable[[DataFrame], DataFrame]
    verdict: Column
    helpers: tuple[str, ...] = ()
    joins: bool = False  # prepare() reads the frame twice
    search: FieldSearch | None = None  # done for all graders in one pass


Builder = Callable[[dict, Context, str], Grader]
_BUILDERS: dict[str, Builder] = {}


def register_grader(kind: str) -> Callable[[Builder], Builder]:
    """Register a builder ``(definition, context, slot) -> Grader`` for a grader type."""

    def keep(builder: Builder) -> Builder:
        _BUILDERS[kind] = builder
        return builder

    return keep


def grader_types() -> list[str]:
    for point in importlib.metadata.entry_points(group=ENTRY_POINTS):
        if point.name not in _BUILDERS:
            _BUILDERS[point.name] = point.load()
    return sorted(_BUILDERS)


def build_graders(definitions: list[dict], context: Context, default_model: str = "") -> list[Grader]:
    """Check definitions and build their graders (unknown types are an error)."""
    graders = []
    for i, definition in enumerate(definitions):
        kind = definition.get("type", "prompt")
        if kind not in grader_types():
            raise ValueError(f"Unknown grader: {kind!r}. Available: {', '.join(grader_types())}")
        filled = {**definition, "model": definition.get("model") or default_model}
        graders.append(_BUILDERS[kind](filled, context, f"_grader{i}"))
    return graders


def threshold_of(definition: dict) -> float | None:
    """The threshold; the default applies only when the key is absent."""
    kind = definition.get("type", "prompt")
    return definition.get("threshold", DEFAULT_THRESHOLDS.get(kind, DEFAULT_THRESHOLD))


def verdict_struct(
    definition: dict,
    score: Column,
    *,
    error: Column | None = None,
    reasoning: Column | None = None,
    details: Column | None = None,
    raised: Column | None = None,
) -> Column:
    """Verdict of one grader, with its name, threshold and (a judge's) model; ``details`` is a
    JSON object of its own keys. ``raised`` marks rows on which the grader itself failed:
    they carry no score and do not pass."""
    limit = threshold_of(definition)
    raised = F.lit(False) if raised is None else F.coalesce(raised, F.lit(False))
    passed = F.lit(None).cast("boolean") if limit is None else score >= F.lit(float(limit))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(~raised, score).cast("double").alias("score"),
        F.when(raised, False).otherwise(passed).alias("passed"),
        F.lit(float(definition.get("weight", 1.0))).alias("weight"),
        (none if error is None else error).cast("string").alias("error"),
        (none if reasoning is None else reasoning).cast("string").alias("reasoning"),
        (none if details is None else details).cast("string").alias("details_json"),
        F.lit(definition.get("name") or definition.get("type", "prompt")).alias("grader_name"),
        F.lit(None if limit is None else float(limit)).cast("double").alias("threshold"),
        (F.lit(definition.get("model")) if definition.get("type", "prompt") == "prompt" else none).cast("string").alias("model"),
    )


def once(udf):  # noqa: ANN001, ANN201
    """Keep a Python function from being evaluated again for a filter on its result.

    Catalyst copies deterministic expressions into pushed-down filters; it leaves
    non-deterministic ones in place.
    """
    return udf.asNondeterministic()


def _points(matched: Column) -> Column:
    return F.when(matched, 1.0).otherwise(0.0)


def _native(definition: dict, verdict: Column, default_name: str) -> Grader:
    name = definition.get("name", default_name)
    return Grader(name, float(definition.get("weight", 1.0)), lambda df: df, verdict)


# --- native graders ---------------------------------------------------------------


@register_grader("string_check")
def string_check(definition: dict, context: Context, slot: str) -> Grader:
    """Compare two rendered templates."""
    operation = definition.get("operation", "equals")
    if operation not in STRING_OPERATIONS:
        error = F.lit(f"Unknown operation: {operation}")
        return _native(definition, verdict_struct(definition, F.lit(0.0), error=error), "string_check")
    output = F.col(context.actual)
    left, right = (
        template_column(definition.get(key) or "", context.fields(), output)
        for key in ("input_value", "reference_value")
    )
    matched = {
        "equals": left == right,
        "not_equals": left != right,
        "contains": F.contains(left, right),
        "contains_ignore_case": F.contains(F.lower(left), F.lower(right)),
    }[operation]
    details = F.to_json(
        F.struct(
            F.lit(operation).alias("operation"),
            left.alias("resolved_input"),
            right.alias("resolved_reference"),
        )
    )
    return _native(definition, verdict_struct(definition, _points(matched), details=details), "string_check")


@register_grader("exact_match")
def exact_match(definition: dict, context: Context, slot: str) -> Grader:
    """Trimmed equality, optionally without case."""
    left, right = strip(F.col(context.expected)), strip(F.col(context.actual))
    if not definition.get("case_sensitive", True):
        left, right = F.lower(left), F.lower(right)
    matched = F.coalesce(left == right, F.lit(False))
    return _native(definition, verdict_struct(definition, _points(matched)), "exact_match")


@register_grader("pattern_match")
def pattern_match(definition: dict, context: Context, slot: str) -> Grader:
    """Regular expression, or the expected text as a substring."""
    output = F.col(context.actual)
    pattern = definition.get("pattern")
    matched = output.rlike(pattern) if pattern else F.contains(output, F.col(context.expected))
    return _native(
        definition, verdict_struct(definition, _points(F.coalesce(matched, F.lit(False)))), "pattern_match"
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors, four decimals; 0 when a norm is 0.

    The product runs over the shorter length, each norm over its whole vector.
    """
    zero = F.lit(0.0)
    shared = F.least(F.size(left), F.size(right))
    products = F.zip_with(
        F.slice(left, 1, shared), F.slice(right, 1, shared),
        lambda a, b: a.cast("double") * b.cast("double"),
    )

    def norm(vector: Column) -> Column:
        return F.sqrt(F.aggregate(vector, zero, lambda acc, x: acc + x.cast("double") * x.cast("double")))

    dot = F.aggregate(products, zero, lambda acc, x: acc + x)
    parts = F.array(F.struct(dot.alias("dot"), norm(left).alias("a"), norm(right).alias("b")))
    # transform() binds the three sums once for the formula below.
    ratio = F.transform(
        parts,
        lambda p: F.when((p["a"] == 0) | (p["b"] == 0), zero).otherwise(p["dot"] / (p["a"] * p["b"])),
    )
    return F.get(F.transform(ratio, lambda r: exact_round(r, 4)), 0)


@register_grader("semantic_similarity")
def semantic_similarity(definition: dict, context: Context, slot: str) -> Grader:
    """Cosine of two embedding columns, or of embeddings made on the fly by ``embedder``."""
    from gradeloom.operators.inference import embed_columns

    left, right = f"{slot}_expected", f"{slot}_actual"
    vectors = definition.get("vectors")

    def prepare(df: DataFrame) -> DataFrame:
        if vectors:
            return df.withColumn(left, F.col(vectors[0])).withColumn(right, F.col(vectors[1]))
        texts = {context.expected: left, context.actual: right}
        return embed_columns(df, texts, definition["embedder"], definition["spread_by"])

    missing = F.col(left).isNull() | F.col(right).isNull()
    return Grader(
        definition.get("name", "semantic_similarity"),
        float(definition.get("weight", 1.0)),
        prepare,
        verdict_struct(
            definition, cosine(F.col(left), F.col(right)),
            error=F.when(missing, "no embedding"), raised=missing,
        ),
        (left, right),
        joins=not vectors,
    )


# --- JSON graders -----------------------------------------------------------------


def find_fields(document: object, names: tuple[str, ...]) -> dict[str, object]:
    """First field of each name, in one walk: a mapping's own keys, then depth first."""
    found, stack = {}, [document]
    while stack:
        here = stack.pop()
        if isinstance(here, dict):
            for name in names:
                if name in here and name not in found:
                    found[name] = here[name]
            if len(found) == len(names):
                break
            stack.extend(reversed(here.values()))
        elif isinstance(here, list):
            stack.extend(reversed(here))
    return found


def _found(parsed: Column, found: Column, value: Column) -> Column:
    return F.struct(parsed.alias("parsed"), found.alias("found"), value.alias("value"))


def _walk(names: list[str]) -> Callable[[Column, Column], Column]:
    """Values of those ``names`` that a row asks for (bits of ``asked``), one walk a document."""
    values = [f"value{i}" for i in range(len(names))]

    @F.arrow_udf("struct<parsed:boolean," + ",".join(f"{v}:string" for v in values) + ">")
    def walk(texts: pa.Array, asked: pa.Array) -> pa.Array:
        parsed, columns, wanted = [], [[] for _ in names], {}
        for text, bits in zip(texts.to_pylist(), asked.to_pylist(), strict=True):
            if bits not in wanted:
                wanted[bits] = tuple(n for i, n in enumerate(names) if bits[i] == "1")
            found, fits = {}, text is not None
            if fits:
                try:
                    found = find_fields(json.loads(text), wanted[bits])
                except (ValueError, RecursionError):
                    fits = False
            parsed.append(fits)
            for name, column in zip(names, columns, strict=True):
                column.append(str(found[name]) if name in found else None)
        parts = [pa.array(parsed, pa.bool_()), *[pa.array(c, pa.string()) for c in columns]]
        return pa.StructArray.from_arrays(parts, ["parsed", *values])

    return walk


def _plain_text(value: Column) -> Column:
    """Text of a plain VARIANT value, NULL for all others."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    return F.when(kind.isin("STRING", "BIGINT"), text).when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None")


def search_fields(df: DataFrame, searches: list[FieldSearch]) -> DataFrame:
    """Add the finding (``parsed``, ``found``, ``value``) of every search.

    A document's own field comes first; when it is a plain value, the JVM reads it. A
    document without the name in its text (and without escapes, which could spell it) has
    no such field. What is left of all searches in a column crosses to Python once.
    """
    for column in dict.fromkeys(s.column for s in searches):
        names = list(dict.fromkeys(s.name for s in searches if s.column == column))
        output, doc, walked = F.col(column), "_doc", "_walked"
        own, absent = [f"_own{i}" for i in range(len(names))], [f"_absent{i}" for i in range(len(names))]
        out = df.withColumn(doc, F.try_parse_json(output))
        fits, escaped = F.col(doc).isNotNull(), F.contains(output, F.lit("\\"))
        quoted = [n.replace("\\", "\\\\").replace("'", "\\'") for n in names]
        out = out.select(
            *df.columns,
            *[F.try_variant_get(F.col(doc), f"$['{q}']", "variant").alias(o) for q, o in zip(quoted, own, strict=True)],
            *[(fits & ~escaped & ~F.contains(output, F.lit(n))).alias(a) for n, a in zip(names, absent, strict=True)],
        )
        out = out.withColumns({o: _plain_text(F.col(o)) for o in own})
        known = [F.col(o).isNotNull() | F.coalesce(F.col(a), F.lit(False)) for o, a in zip(own, absent, strict=True)]
        bits = F.concat(*[F.when(k, "0").otherwise("1") for k in known])
        text = F.when(F.contains(bits, F.lit("1")), output)
        out = out.withColumn(walked, once(_walk(names))(text, bits))
        slots = []
        for s in searches:
            if s.column == column:
                i = names.index(s.name)
                native = _found(F.lit(True), F.col(own[i]).isNotNull(), F.col(own[i]))
                value = F.col(walked)[f"value{i}"]
                rest = _found(F.col(walked)["parsed"], value.isNotNull(), value)
                slots.append(F.when(known[i], native).otherwise(rest).alias(s.slot))
        df = out.select(*df.columns, *slots)
    return df


@register_grader("json_field")
def json_field(definition: dict, context: Context, slot: str) -> Grader:
    """A named field of the JSON output against the expected text.

    With ``path`` the field is read natively; without it the first field of that
    name anywhere in the document counts, which needs the order of the raw text.
    """
    name = definition.get("field_name") or "key"
    path = definition.get("path")

    def prepare(df: DataFrame) -> DataFrame:
        if not path:
            return df
        value = F.get_json_object(F.col(context.actual), path)
        parsed = F.try_parse_json(F.col(context.actual)).isNotNull()
        return df.withColumn(slot, _found(parsed, value.isNotNull(), value))

    found = F.col(slot)

    def normal(text: Column) -> Column:
        text = strip(text) if definition.get("strip_whitespace") is not False else text
        return text if definition.get("case_sensitive") else F.lower(text)

    same = normal(F.col(context.expected)) == normal(found["value"])
    error = F.when(~found["parsed"], "Failed to parse actual output as JSON").when(
        ~found["found"], f"Field '{name}' not found in response"
    )
    details = F.to_json(F.struct(F.lit(name).alias("field_name"), found["value"].alias("extracted_value")))
    return Grader(
        definition.get("name", "json_field"),
        float(definition.get("weight", 1.0)),
        prepare,
        verdict_struct(definition, _points(F.coalesce(same, F.lit(False))), error=error, details=details),
        (slot,),
        search=None if path else FieldSearch(context.actual, name, slot),
    )


@register_grader("json_schema")
def json_schema(definition: dict, context: Context, slot: str) -> Grader:
    """Whether the JSON output fits the schema."""
    schema = definition.get("schema")
    if not isinstance(schema, dict):
        raise ValueError("JSON schema grader requires a schema object")
    check = F.col(slot)
    return Grader(
        definition.get("name", "json_schema"),
        float(definition.get("weight", 1.0)),
        lambda df: validate(df, context.actual, schema, slot),
        verdict_struct(
            definition, _points(check["valid"]), error=check["error"], details=F.to_json(check)
        ),
        (slot,),
    )


# --- user code --------------------------------------------------------------------


class UserScope(dict):
    """Global names of user code: the allowed modules, and builtins whose import looks names up here.

    The name lists keep honest code honest; they are no sandbox.
    """

    def __init__(self):
        super().__init__(ALLOWED_MODULES)
        self["__builtins__"] = {name: vars(builtins)[name] for name in ALLOWED_BUILTINS}
        self["__builtins__"]["__import__"] = lambda name, *_: self.module(name)

    @staticmethod
    def module(name: str) -> object:
        try:
            return ALLOWED_MODULES[name]
        except KeyError:
            choice = ", ".join(sorted(ALLOWED_MODULES))
            raise ImportError(f"Import of '{name}' is not allowed. Available modules: {choice}") from None


def load_user_grade(source: str) -> Callable[[dict, dict], object]:
    """Run user source and return its ``grade`` function.

    Only grade with source from people who may run code on the cluster.
    """
    scope = UserScope()
    exec(source, scope)  # noqa: S102 - running user code is the feature
    return scope.get("grade")


def _user_scores(source: str) -> Callable[..., Column]:
    @F.pandas_udf("struct<score:double,error:string>")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        problem = None
        try:
            grade = load_user_grade(source)
            if not callable(grade):
                problem = "Source code must define a callable 'grade(sample, item)' function."
        except Exception as exc:  # user code may raise anything
            problem = f"Execution error: {exc}"

        def one(output: str | None, item: str) -> tuple[float, str | None]:
            if problem is not None:
                return 0.0, problem
            try:
                raw = float(grade({"output_text": output}, json.loads(item)))
            except Exception as exc:
                return 0.0, f"grade() raised: {exc}"
            # Written so that NaN ends at 1.0 like min(1.0, nan).
            return (raw if raw < 1.0 else 1.0) if raw > 0.0 or raw != raw else 0.0, None

        for outputs, items in batches:
            rows = [one(o, i) for o, i in zip(outputs, items, strict=True)]
            yield pd.DataFrame(rows, columns=["score", "error"])

    return scores


@register_grader("python")
def python_grader(definition: dict, context: Context, slot: str) -> Grader:
    """User function ``grade(sample, item)``, compiled once per partition."""
    fields = context.fields()
    item = fields if isinstance(fields, Column) else (
        F.struct(*[c.alias(n) for n, c in fields.items()]) if fields else None
    )
    as_json = F.lit("{}") if item is None else F.to_json(item, {"ignoreNullFields": "false"})
    call = once(_user_scores(definition.get("source_code") or ""))
    return Grader(
        definition.get("name", "python_grader"),
        float(definition.get("weight", 1.0)),
        lambda df: df.withColumn(slot, call(F.col(context.actual), as_json)),
        verdict_struct(definition, F.col(slot)["score"], error=F.col(slot)["error"]),
        (slot,),
    )


# --- judge ------------------------------------------------------------------------


# What user-facing messages call the kinds of JSON values.
_KIND_NAMES = {"VOID": "NoneType", "STRING": "str", "BOOLEAN": "bool", "BIGINT": "int", "ARRAY": "list", "OBJECT": "dict"}


def _kind_name(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    named = F.lit("float")
    for prefix, name in _KIND_NAMES.items():
        named = F.when(kind.startswith(prefix), name).otherwise(named)
    return named


def parse_judge_reply(reply: Column) -> Column:
    """``struct(score, reasoning, failed)`` from a judge's answer.

    Text that is no JSON and a score that is no number as text score 0. An answer that is
    JSON but no object, or whose score is null, a list or an object, fails the grader:
    ``failed`` is the message and there is no score. No clamp: a judge that answers 1.4
    scores 1.4.
    """
    doc = F.try_parse_json(reply)
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    raw = F.try_variant_get(doc, "$.score", "variant")
    kind = _kind_name(raw)
    failed = F.when(~is_object, F.concat(F.lit("'"), _kind_name(doc), F.lit("' object has no attribute 'get'"))).when(
        kind.isin("NoneType", "list", "dict"),
        F.concat(F.lit("float() argument must be a string or a real number, not '"), kind, F.lit("'")),
    )
    score = F.when(raw.isNull(), F.lit(0.0)).otherwise(F.try_variant_get(raw, "$", "double"))
    readable = is_object & score.isNotNull()
    excerpt = F.concat(F.lit("Failed to parse grader response: "), F.substring(reply, 1, 200))
    reasoning = F.coalesce(F.try_variant_get(doc, "$.reasoning", "string"), F.lit(""))
    return F.struct(
        F.when(failed.isNull(), F.when(readable, score).otherwise(F.lit(0.0))).alias("score"),
        F.when(failed.isNull(), F.when(readable, reasoning).otherwise(excerpt)).alias("reasoning"),
        failed.alias("failed"),
    )


@register_grader("prompt")
def prompt_grader(definition: dict, context: Context, slot: str) -> Grader:
    """A model judges the output: prompt column, batch inference, parsed reply."""
    from gradeloom.operators.inference import generate, request_column

    provider = definition.get("provider")
    reply = f"{slot}_reply"

    def prepare(df: DataFrame) -> DataFrame:
        if provider is None:
            raise ValueError("a prompt grader needs a provider")
        prompt = judge_prompt(
            definition.get("prompt") or "",
            F.coalesce(F.col(context.expected), F.lit("")),
            F.coalesce(F.col(context.actual), F.lit("")),
        )
        request = request_column(
            model=F.lit(definition["model"]),
            system_prompt=F.lit(JUDGE_INSTRUCTION),
            user_input=prompt,
            temperature=F.lit(0.0),
        )
        asked = df.withColumn(slot, request)
        answered = generate(asked, provider, request=slot, out=reply)
        return answered.withColumn(slot, parse_judge_reply(F.col(reply)["text"]))

    failed = F.coalesce(F.col(reply)["error"], F.col(slot)["failed"])
    return Grader(
        definition.get("name", "custom_grader"),
        float(definition.get("weight", 1.0)),
        prepare,
        verdict_struct(
            definition,
            F.col(slot)["score"],
            error=failed,
            reasoning=F.when(failed.isNull(), F.col(slot)["reasoning"]),
            raised=failed.isNotNull(),
        ),
        (slot, reply),
    )


# --- all graders of a row ---------------------------------------------------------


def grade(df: DataFrame, graders: list[Grader]) -> DataFrame:
    """Add ``details`` (grader name to verdict), ``score`` and ``passed``.

    Rows whose ``error`` column is set (generation failed) stay ungraded. When
    names repeat, the last definition supplies the weight and the map entry, yet
    every verdict counts in the combination.
    """
    if not graders:
        raise ValueError("at least one grader is required")
    out = df
    # Those that join come first, before any model call is part of the plan.
    for grader in [g for g in graders if g.joins]:
        out = grader.prepare(out)
    out = search_fields(out, [g.search for g in graders if g.search])
    for grader in [g for g in graders if not g.joins]:
        out = grader.prepare(out)
    weights = {g.name: g.weight for g in graders}
    verdicts = [g.verdict.withField("weight", F.lit(weights[g.name])) for g in graders]
    last = {g.name: i for i, g in enumerate(graders)}
    ok = F.col("error").isNull() if "error" in df.columns else F.lit(True)
    out = out.select(*df.columns, *[v.alias(f"_verdict{i}") for i, v in enumerate(verdicts)])
    parts = [F.col(f"_verdict{i}") for i in range(len(verdicts))]
    entries = [part for n, i in last.items() for part in (F.lit(n), parts[i])]
    score, passed = _combined(parts, [weights[g.name] for g in graders])
    return out.select(
        *df.columns,
        F.when(ok, F.create_map(*entries)).alias("details"),
        F.when(ok, score).alias("score"),
        F.when(ok, passed).alias("passed"),
    )


def _combined(verdicts: list[Column], weights: list[float]) -> tuple[Column, Column]:
    """``summary.weighted_verdict`` for graders known while planning: plain arithmetic."""
    active = [(v, w) for v, w in zip(verdicts, weights, strict=True) if w > 0]
    if not active:
        return F.lit(0.0), F.lit(False)
    total = sum(F.lit(w) * F.coalesce(v["score"], F.lit(0.0)) for v, w in active)
    # NULL verdicts are left out: all true, and at least one known.
    known = F.coalesce(*[v["passed"] for v, _ in active])
    every = F.lit(True)
    for v, _ in active:
        every = every & F.coalesce(v["passed"], F.lit(True))
    return total / F.lit(sum(w for _, w in active)), F.when(known.isNotNull(), every)
