"""Row templates: ``{{ item.field }}`` and ``{{ sample.output_text }}`` as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the placeholder form.
PLACEHOLDER = re.compile(r"\{\{\s*(\w+(?:\.\w+)*)\s*\}\}")


def template_column(template: str, item: dict[str, Column] | Column, output: Column) -> Column:
    """Rendered template. What cannot be resolved stays as it is written.

    ``item`` maps field names to columns, or is one ``map<string,string>`` column
    whose keys are only known per row. The text is split once on the driver, so
    rows see a plain ``concat``.
    """

    def value(match: re.Match[str]) -> Column:
        written = F.lit(match.group(0))
        root, _, field = match.group(1).partition(".")
        if match.group(1) == "sample.output_text":
            return F.coalesce(output, F.lit("None"))
        if root != "item" or not field:
            return written
        if isinstance(item, Column):
            return F.when(F.map_contains_key(item, field), item[field]).otherwise(written)
        return F.coalesce(item[field].cast("string"), F.lit("None")) if field in item else written

    parts: list[Column] = []
    end = 0
    for match in PLACEHOLDER.finditer(template):
        if match.start() > end:
            parts.append(F.lit(template[end : match.start()]))
        parts.append(value(match))
        end = match.end()
    if end < len(template) or not parts:
        parts.append(F.lit(template[end:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def judge_prompt(template: str, expected: Column, actual: Column) -> Column:
    """Judge prompt: both placeholders filled, or both texts appended when neither occurs.

    Values are inserted once each, so braces inside them stay as they are.
    """
    pieces = re.split(r"(\{expected\}|\{actual\})", template)
    if len(pieces) == 1:
        return F.concat(
            F.lit(f"{template}\n\nExpected output:\n"), expected,
            F.lit("\n\nActual output:\n"), actual,
        )
    values = {"{expected}": expected, "{actual}": actual}
    return F.concat(*[values.get(piece, F.lit(piece)) for piece in pieces if piece])
