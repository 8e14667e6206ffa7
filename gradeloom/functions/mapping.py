"""Field mappings: text such as ``{status == "F" ? "done" : "open"}`` as columns.

A mapping is read once on the driver against the record's schema and becomes an
ordinary Spark expression, so rows never meet an interpreter. Three kinds of
values flow through it:

* a typed column (struct, array, map or scalar of the record),
* JSON text (the result of ``parse_json``), whose type is only known per row,
* nothing (a path the schema does not have), which is NULL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.numbers import float_text

# Fixed values of the mapping language.
TEMPLATE = re.compile(r"\{([^{}]+)\}")
NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
NUMBER_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<", "=")
CALL = re.compile(r"([A-Za-z_]\w*)\((.*)", re.DOTALL)
PATH_STEP = re.compile(r"\[(\d*)\]|((?:[^.\[]|\[(?!\d*\]))+)")
QUOTED = re.compile(r"""("|')(?:\\.|(?!\1).)*(?:\1|$)""", re.DOTALL)

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


class _JsonText(T.StringType):
    """Marks a string column that holds JSON text of unknown type."""


@dataclass(frozen=True)
class Value:
    """A column with its type; ``raw`` keeps the record's own JSON text and path when known."""

    col: Column
    type: T.DataType
    raw: tuple[Column, str] | None = None
    constant: tuple[object, ...] = ()  # the value itself when the mapping text spells it out

    @property
    def is_list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_json(self) -> bool:
        return isinstance(self.type, _JsonText)

    @property
    def is_loose(self) -> bool:
        """Text read from JSON, which may have been a number or boolean there."""
        return self.is_json or (isinstance(self.type, T.StringType) and self.raw is not None)




def _nothing() -> Value:
    return Value(F.lit(None).cast("string"), T.NullType())


# --- reading the text ----------------------------------------------------------


def _unquoted(text: str) -> str:
    """The text with quoted parts blanked out, positions unchanged."""
    return QUOTED.sub(lambda m: "\0" * len(m.group()), text)


def _outer(text: str) -> str:
    """The text without anything inside quotes, brackets or parentheses."""
    square = round_ = 0
    shown = []
    for char in _unquoted(text):
        square += char == "["
        round_ += char == "("
        shown.append("\0" if square or round_ else char)
        square -= char == "]" and square > 0
        round_ -= char == ")" and round_ > 0
    return "".join(shown)


def _literal(text: str) -> Value | None:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return Value(F.lit(text[1:-1]), T.StringType(), constant=(_plain(text[1:-1]),))
    known = {"true": True, "false": False}
    if text in known:
        return Value(F.lit(known[text]), T.BooleanType(), constant=(known[text],))
    if text == "null":
        return Value(F.lit(None).cast("string"), T.NullType(), constant=(None,))
    if NUMBER.fullmatch(text):
        if "." in text:
            return Value(F.lit(float(text)), T.DoubleType(), constant=(float(text),))
        kind = T.LongType() if len(text.lstrip("-")) <= 18 else T.DecimalType(38, 0)
        return Value(F.lit(text).cast(kind), kind, constant=(int(text),))
    return None


def _plain(text: str) -> object:
    """What a text counts as in a comparison."""
    inner = _literal(text)
    if inner is None:
        return text
    # The quotes of quoted text come off once.
    return text[1:-1] if text[0] in "\"'" else inner.constant[0]


def _call(text: str) -> tuple[str, list[str], str] | None:
    """Split ``name(a, b).rest`` into name, arguments and trailing path."""
    match = CALL.fullmatch(text)
    if match is None or match.group(1) not in FUNCTIONS:
        return None
    name = match.group(1)
    depth = 0
    for i, char in enumerate(_unquoted(text)):
        depth += (char == "(") - (char == ")")
        if depth == 0 and char == ")":
            return name, _arguments(text[len(name) + 1 : i].strip()), text[i + 1 :].removeprefix(".")
    return None


def _arguments(body: str) -> list[str]:
    if not body:
        return []
    cuts = [-1, *[i for i, c in enumerate(_outer(body)) if c == ","], len(body)]
    return [body[a + 1 : b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def path_steps(path: str | None) -> list[str | int | None]:
    """Field names, list positions, and ``None`` for the ``[]`` wildcard."""
    text = (path or "").strip().removeprefix("$")
    steps: list[str | int | None] = []
    for match in PATH_STEP.finditer(text):
        index, name = match.groups()
        steps.append(name if name is not None else int(index) if index else None)
    return steps


# --- paths ----------------------------------------------------------------------


def _deeper(value: Value, step: str | int) -> tuple[Column, str] | None:
    if value.raw is None:
        return None
    text, path = value.raw
    return text, path + (f"[{step}]" if isinstance(step, int) else f"['{step}']")


def resolve(value: Value, steps: list[str | int | None]) -> Value:
    """Follow a path; what does not exist, or has another shape, is NULL."""
    if not steps:
        return value
    if value.is_json:
        return _resolve_json(value, steps)
    step, rest = steps[0], steps[1:]
    if step is None:
        if not value.is_list:
            return _nothing()
        element = value.type.elementType
        inner_type = resolve(Value(F.lit(None), element), rest).type
        found = F.transform(value.col, lambda item: resolve(Value(item, element), rest).col)
        known = F.filter(found, lambda item: item.isNotNull())
        if isinstance(inner_type, T.ArrayType):
            return Value(F.flatten(known), inner_type)
        if isinstance(inner_type, T.NullType):
            inner_type = T.StringType()
        return Value(known, T.ArrayType(inner_type))
    if isinstance(step, int):
        if not value.is_list:
            return _nothing()
        return resolve(
            Value(F.get(value.col, step), value.type.elementType, _deeper(value, step)), rest
        )
    if isinstance(value.type, T.MapType):
        return resolve(Value(value.col[step], value.type.valueType, _deeper(value, step)), rest)
    if not isinstance(value.type, T.StructType) or step not in value.type.fieldNames():
        return _nothing()
    return resolve(
        Value(value.col.getField(step), value.type[step].dataType, _deeper(value, step)), rest
    )


def _json_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _json_value(text: Column, path: str) -> Value:
    """Part of a JSON text; a text that is no JSON as a whole has no parts.

    transform() over one element evaluates the text once for both uses.
    """
    part = F.transform(
        F.array(text), lambda t: F.when(F.try_parse_json(t).isNotNull(), F.get_json_object(t, path))
    )
    return Value(F.get(part, 0), _JsonText(), (text, path))


def _resolve_json(value: Value, steps: list[str | int | None]) -> Value:
    text, base = value.raw if value.raw is not None else (value.col, "$")
    at = steps.index(None) if None in steps else len(steps)
    part = _json_value(text, base + _json_path(steps[:at])[1:])
    if at == len(steps):
        return part
    return resolve(_json_items(part), steps[at:]) if steps[at + 1 :] else _json_items(part)


def _json_items(value: Value) -> Value:
    return Value(F.from_json(value.col, "array<string>"), T.ArrayType(_JsonText()))


# --- text of a value ------------------------------------------------------------


def as_text(value: Value) -> Column:
    """The stored text: NULL is empty, lists and objects are compact JSON."""
    kind = value.type
    if isinstance(kind, T.NullType):
        return F.lit("")
    if value.is_loose:
        text = F.when(_json_kind(value) == "BOOLEAN", F.initcap(value.col)).otherwise(value.col)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        if value.raw is not None:
            text = F.get_json_object(*value.raw)
        else:
            text = F.to_json(value.col)
    elif isinstance(kind, T.BooleanType):
        text = F.when(value.col, "True").when(~value.col, "False")
    elif isinstance(kind, _FRACTIONAL):
        text = float_text(value.col)
        if value.raw is not None:
            # A whole number in the JSON text stays one, whatever the schema says.
            written = F.regexp_extract(F.get_json_object(*value.raw), "^-?[0-9]+$", 0)
            whole = F.when(value.col == F.floor(value.col), F.nullif(written, F.lit("")))
            text = F.coalesce(whole, text)
    else:
        text = value.col.cast("string")
    return F.coalesce(text, F.lit(""))


def _json_kind(value: Value) -> Column:
    """Type name of a value read from JSON text; only looked up where it matters."""
    text, path = value.raw if value.raw is not None else (value.col, "$")
    # A boolean and the string of the same letters differ only here.
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    return F.when(value.col.isin("true", "false"), kind)


# --- conditions ------------------------------------------------------------------


def _scalar(value: Value) -> Column:
    """Comparable form ``struct(k, n, t)``: kind, number, text.

    Text that reads as a number, boolean, null or quoted text counts as that.
    """

    def form(kind: Column, number: Column, text: Column) -> Column:
        return F.struct(
            kind.alias("k"), number.cast("double").alias("n"), text.cast("string").alias("t")
        )

    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    null_form = form(F.lit("z"), none, no_text)
    kind, col = value.type, value.col
    if isinstance(kind, T.NullType):
        return null_form
    if isinstance(kind, T.BooleanType):
        return F.when(col.isNull(), null_form).otherwise(form(F.lit("b"), col.cast("int"), no_text))
    if isinstance(kind, _NUMERIC):
        return F.when(col.isNull(), null_form).otherwise(form(F.lit("n"), col, col.cast("string")))
    if isinstance(kind, T.StringType):
        quoted = col.rlike(r"""(?s)^("|').*\1$""") & (F.length(col) >= 2)
        inner = F.substr(col, F.lit(2), F.length(col) - 2)
        return (
            F.when(col.isNull() | (col == "null"), null_form)
            .when(col == "true", form(F.lit("b"), F.lit(1.0), no_text))
            .when(col == "false", form(F.lit("b"), F.lit(0.0), no_text))
            .when(col.rlike(NUMBER_TEXT), form(F.lit("n"), col.try_cast("double"), col))
            .when(quoted, form(F.lit("s"), none, inner))
            .otherwise(form(F.lit("s"), none, col))
        )
    return F.when(col.isNull(), null_form).otherwise(form(F.lit("o"), none, F.to_json(col)))


def _equal_scalars(left: Column, right: Column) -> Column:
    numeric = left["k"].isin("n", "b") & right["k"].isin("n", "b")
    # Long integers compare by their digits; a double would merge neighbours.
    long_ints = (
        (left["k"] == "n") & (right["k"] == "n")
        & left["t"].rlike("^-?[0-9]{16,}$") & right["t"].rlike("^-?[0-9]{16,}$")
    )
    return (
        F.when(long_ints, left["t"] == right["t"])
        .when(numeric, left["n"] == right["n"])
        .otherwise((left["k"] == right["k"]) & left["t"].eqNullSafe(right["t"]))
    )


_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def _may_convert(text: Column) -> Column:
    """Whether a text could count as a number, boolean, null or quoted text."""
    return F.coalesce(F.substring(text, 1, 1).isin(*"-0123456789tfn\"'"), F.lit(True))


def _equals_constant(value: Value, constant: object) -> Column | None:
    """A scalar column against a constant, without building comparable forms.

    None when the general way is needed.
    """
    kind, col = value.type, value.col
    if constant is None:
        if isinstance(kind, T.StringType):
            return col.isNull() | (col == "null")
        return col.isNull()
    number = constant if isinstance(constant, (int, float)) else None
    if number is not None and abs(number) >= 10**15:
        return None
    if isinstance(kind, _NUMERIC):
        return F.lit(False) if number is None else col == F.lit(float(number))
    if isinstance(kind, T.BooleanType):
        return F.lit(False) if number is None else col.cast("int") == F.lit(float(number))
    if isinstance(kind, T.StringType):
        if number is None:
            return col.isin(constant, f'"{constant}"', f"'{constant}'")
        same = F.when(col.rlike(NUMBER_TEXT), col.try_cast("double") == F.lit(float(number)))
        word = {0: "false", 1: "true"}.get(number)
        return same if word is None else (col == word) | F.coalesce(same, F.lit(False))
    return None


def _ordered_by_constant(value: Value, constant: object, sign: str, *, constant_left: bool) -> Column | None:
    """Order of a numeric column or numeric text against a number."""
    if isinstance(constant, bool) or not isinstance(constant, (int, float)):
        return None
    test, bound = _ORDER[sign], F.lit(float(constant))
    if isinstance(value.type, _NUMERIC):
        number = value.col.cast("double")
    elif isinstance(value.type, T.StringType):
        number = F.when(value.col.rlike(NUMBER_TEXT), value.col.try_cast("double"))
    else:
        return None
    return test(bound, number) if constant_left else test(number, bound)


def _ordered_scalars(left: Column, right: Column, sign: str) -> Column:
    test = _ORDER[sign]
    same = left["k"] == right["k"]
    return (
        F.when(same & left["k"].isin("n", "b"), test(left["n"], right["n"]))
        .when(same & (left["k"] == "s"), test(left["t"], right["t"]))
        .otherwise(F.lit(False))
    )


def _any_item(values: Value, test: Callable[[Value], Column]) -> Column:
    """True when an item passes; a NULL list counts as the scalar NULL."""
    element = values.type.elementType
    hit = F.exists(values.col, lambda item: F.coalesce(test(Value(item, element)), F.lit(False)))
    return F.when(values.col.isNull(), test(_nothing())).otherwise(hit)


def _equal(left: Value, right: Value) -> Column:
    if left.is_list and right.is_list:
        pairs = F.zip_with(
            left.col, right.col,
            lambda a, b: _equal(Value(a, left.type.elementType), Value(b, right.type.elementType)),
        )
        same = (F.size(left.col) == F.size(right.col)) & F.forall(pairs, lambda p: p)
        one_null = left.col.isNull() | right.col.isNull()
        return F.when(one_null, left.col.isNull() & right.col.isNull()).otherwise(same)
    if left.is_list:
        return _any_item(left, lambda item: _equal(item, right))
    if right.is_list:
        return _any_item(right, lambda item: _equal(left, item))
    for value, other in ((left, right), (right, left)):
        if other.constant and not value.constant:
            quick = _equals_constant(value, other.constant[0])
            if quick is not None:
                return quick
    if isinstance(left.type, _NUMERIC) and isinstance(right.type, _NUMERIC):
        return left.col.eqNullSafe(right.col)
    general = _equal_scalars(_scalar(left), _scalar(right))
    if isinstance(left.type, T.StringType) and isinstance(right.type, T.StringType):
        plain_words = ~_may_convert(left.col) & ~_may_convert(right.col)
        return F.when(left.col.eqNullSafe(right.col), True).when(plain_words, False).otherwise(general)
    return general


def _ordered(left: Value, right: Value, sign: str) -> Column:
    if left.is_list:
        return _any_item(left, lambda item: _ordered(item, right, sign))
    if right.is_list:
        return _any_item(right, lambda item: _ordered(left, item, sign))
    if right.constant:
        quick = _ordered_by_constant(left, right.constant[0], sign, constant_left=False)
    elif left.constant:
        quick = _ordered_by_constant(right, left.constant[0], sign, constant_left=True)
    elif isinstance(left.type, _NUMERIC) and isinstance(right.type, _NUMERIC):
        quick = _ORDER[sign](left.col, right.col)
    else:
        quick = None
    return quick if quick is not None else _ordered_scalars(_scalar(left), _scalar(right), sign)


def _truthy(value: Value) -> Column:
    kind, col = value.type, value.col
    if isinstance(kind, T.NullType):
        return F.lit(False)
    if value.is_loose:
        text, path = value.raw if value.raw is not None else (col, "$")
        node = F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), path, "variant"))
        # Only these look false; a string of the same letters is true.
        falsy = col.rlike(r"^(-?0+(\.0+)?|false|null|\[\]|\{\})$")
        hit = F.when(col == "", False).when(falsy, node == "STRING").otherwise(True)
        hit = F.when(col.isNotNull(), hit)
    elif isinstance(kind, T.BooleanType):
        hit = col
    elif isinstance(kind, _NUMERIC):
        hit = col != 0
    elif isinstance(kind, T.StringType):
        hit = col != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        hit = F.size(col) > 0
    else:
        hit = col.isNotNull()
    return F.coalesce(hit, F.lit(False))


def condition(record: Value, text: str) -> Column:
    """A comparison, or the truth of a value."""
    text = text.strip()
    outer = _outer(text)
    for sign in COMPARISONS:
        at = outer.find(sign)
        if at < 0:
            continue
        left = expression(record, text[:at])
        right = expression(record, text[at + len(sign) :])
        if sign in _ORDER:
            return F.coalesce(_ordered(left, right, sign), F.lit(False))
        same = F.coalesce(_equal(left, right), F.lit(False))
        return ~same if sign == "!=" else same
    return _truthy(expression(record, text))


# --- expressions -----------------------------------------------------------------


def _parse_json(record: Value, args: list[str]) -> Value:
    """Read text as JSON; invalid text is NULL, structured values pass through."""
    if len(args) != 1:
        return _nothing()
    value = expression(record, args[0])
    if isinstance(value.type, (T.StructType, T.ArrayType, T.MapType, T.NullType)):
        return value
    if isinstance(value.type, T.StringType):
        return _json_value(value.col, "$")
    if isinstance(value.type, T.BooleanType):
        return _nothing()  # "True" is no JSON
    return value


def _find(record: Value, args: list[str]) -> Value:
    """First list item that meets a condition, with the item as the record."""
    if len(args) != 2:
        return _nothing()
    items = expression(record, args[0])
    if items.is_json:
        items = _json_items(items)
    if not items.is_list:
        return _nothing()
    element = items.type.elementType
    hits = F.filter(items.col, lambda item: condition(Value(item, element), args[1]))
    return Value(F.get(hits, 0), element)


FUNCTIONS: dict[str, Callable[[Value, list[str]], Value]] = {"parse_json": _parse_json, "find": _find}


def expression(record: Value, text: str) -> Value:
    """One expression: conditional, literal, function call or path."""
    text = text.strip()
    if not text:
        return _nothing()
    outer = _outer(text)
    mark = outer.find("?")
    if mark >= 0:
        colon = outer.find(":", mark + 1)
        if colon < 0:
            raise ValueError("Conditional mapping expressions must include ':'")
        test = condition(record, text[:mark])
        yes = expression(record, text[mark + 1 : colon])
        no = expression(record, text[colon + 1 :])
        return _choose(test, yes, no)
    literal = _literal(text)
    if literal is not None:
        return literal
    call = _call(text)
    if call is not None:
        name, args, rest = call
        return resolve(FUNCTIONS[name](record, args), path_steps(rest))
    return resolve(record, path_steps(text))


def _choose(test: Column, yes: Value, no: Value) -> Value:
    """A conditional keeps a shared type; otherwise both branches become text."""
    if yes.type == no.type and not yes.is_json:
        return Value(F.when(test, yes.col).otherwise(no.col), yes.type)
    return Value(F.when(test, as_text(yes)).otherwise(as_text(no)), T.StringType())


def mapping_column(record: Value, text: str) -> Column:
    """Text column for one mapping: a template with ``{...}``, or one expression."""
    if not text:
        return F.lit("")
    pieces = TEMPLATE.split(text)  # odd positions hold the expressions
    if len(pieces) == 1:
        return as_text(expression(record, text))
    parts = [
        as_text(expression(record, piece)) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts)


# --- records ---------------------------------------------------------------------


def typed_record(df: DataFrame, column: str) -> Value:
    """A struct (or map) column as the record."""
    return Value(F.col(column), df.schema[column].dataType)


def json_record(column: str, schema: T.DataType | str) -> Value:
    """A JSON text column as the record, read with a declared schema.

    Lists and objects that are stored as a whole come straight from the text, so
    key order, NULLs and number forms stay as they were.
    """
    kind = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    return Value(F.from_json(F.col(column), kind), kind, (F.col(column), "$"))


def infer_record_type(df: DataFrame, column: str) -> T.DataType:
    """Schema of JSON text, merged over all rows in one aggregation.

    Only the schema text reaches the driver. A field with mixed types becomes
    text, so every row keeps its value; so do integers of more than 18 digits.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("t")).first()["t"]
    ddl = re.sub(r"\bOBJECT<", "STRUCT<", found or "STRING")
    # Integers are BIGINT; a DECIMAL comes from a fraction (1.0 too) or a long integer.
    ddl = re.sub(r"\bDECIMAL\((19|[23]\d),0\)", "STRING", ddl)
    ddl = re.sub(r"\bDECIMAL\(\d+,\d+\)|\bFLOAT\b", "DOUBLE", ddl)
    ddl = re.sub(r"\b(VARIANT|VOID)\b", "STRING", ddl)
    return T.DataType.fromDDL(ddl)


def staged(df: DataFrame, record: Value) -> tuple[DataFrame, Value]:
    """Parse a JSON record once, in a column of its own, before many paths read it."""
    if record.raw is None:
        return df, record
    return df.withColumn("_record", record.col), replace(record, col=F.col("_record"))


def map_records(
    df: DataFrame, record: Value, mapping: dict[str, str], columns: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One text column per target column; a column without a mapping is empty."""
    df, record = staged(df, record)
    names = columns if columns is not None else list(mapping)
    made = [mapping_column(record, mapping.get(name, "")).alias(name) for name in names]
    return df.select(*(keep or []), *made)
