"""Canonical JSON text of typed columns: sorted keys, ``", "`` and ``": "`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.numbers import float_text


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    # to_json escapes the text; what surrounds it is {"v":...}
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def canonical_json(
    col: Column,
    kind: T.DataType,
    *,
    null_keys: tuple[str, ...] = (),
    raw_keys: tuple[str, ...] = (),
    merge_key: str | None = None,
) -> Column:
    """JSON text of ``col``; NULL when the column is NULL.

    A NULL struct field counts as an absent key, except those in ``null_keys``.
    String fields in ``raw_keys`` already hold JSON and are placed as they are. The string
    field ``merge_key`` holds a JSON object whose keys become keys of the struct itself, in
    place of a field of the same name.
    """
    again = {"null_keys": null_keys, "raw_keys": raw_keys, "merge_key": merge_key}
    if isinstance(kind, T.StructType):
        parts, names = [], []
        for field in sorted(kind.fields, key=lambda f: f.name):
            if field.name == merge_key:
                continue
            names.append(field.name)
            value = col.getField(field.name)
            raw = field.name in raw_keys
            text = value if raw else canonical_json(value, field.dataType, **again)
            if field.name in null_keys:
                text = F.coalesce(text, F.lit("null"))
            parts.append(F.concat(F.lit(f'"{field.name}": '), text))  # NULL without a value
        body = F.concat_ws(", ", *parts)  # skips NULL
        if merge_key in kind.fieldNames():
            text = col.getField(merge_key)
            body = F.when(text.isNull(), body).otherwise(_merged(names, parts, text))
        return F.when(col.isNotNull(), F.concat(F.lit("{"), body, F.lit("}")))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.array_sort(F.map_keys(col)),
            lambda k: F.concat(
                quoted(k), F.lit(": "),
                F.coalesce(canonical_json(col[k], kind.valueType, **again), F.lit("null")),
            ),
        )
        return F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(
            col, lambda x: F.coalesce(canonical_json(x, kind.elementType, **again), F.lit("null"))
        )
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    if isinstance(kind, T.StringType):
        return F.when(col.isNotNull(), quoted(col))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float_text(col)
    return col.cast("string")


def _merged(names: list[str], parts: list[Column], text: Column) -> Column:
    """Texts of struct fields and the entries of a JSON object, sorted by key."""
    own = F.try_variant_get(F.parse_json(text), "$", "map<string,variant>")
    fields = F.array(*[F.struct(F.lit(n).alias("k"), p.alias("t")) for n, p in zip(names, parts, strict=True)])
    fields = F.filter(fields, lambda e: e["t"].isNotNull() & ~F.map_contains_key(own, e["k"]))
    added = F.transform(
        F.map_entries(own),
        lambda e: F.struct(e["key"].alias("k"), F.concat(quoted(e["key"]), F.lit(": "), F.to_json(e["value"])).alias("t")),
    )
    return F.array_join(F.transform(F.array_sort(F.concat(fields, added)), lambda e: e["t"]), ", ")


def datetime_text(col: Column) -> Column:
    """Timestamp as text, with all six fraction digits when there are any."""
    text = col.cast("string")  # drops trailing zeros of the fraction
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def bool_text(col: Column) -> Column:
    return F.when(col, "True").when(~col, "False")
