"""Paths found in JSON text: lists for record extraction, fields for mappings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _walk(value: object, path: str, sample: int | None) -> Iterator[tuple[str, str]]:
    """``(kind, path)`` of every place: ``list``, ``empty`` object, or ``leaf``."""
    if isinstance(value, dict):
        if not value:
            yield "empty", path
        for key, inner in value.items():
            yield from _walk(inner, f"{path}.{key}" if path else key, sample)
    elif isinstance(value, list):
        yield "list", path
        for inner in value[:sample]:
            yield from _walk(inner, f"{path}[]", sample)
    else:
        yield "leaf", path


def _paths(df: DataFrame, column: str, root: str, kinds: tuple[str, ...], sample: int | None) -> DataFrame:
    """Distinct paths over all rows; each task only passes on what it has not seen yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            found = set()
            for text in batch[column]:
                if text is None:
                    continue
                places = list(_walk(json.loads(text), root, sample))  # text that is no JSON stops the job
                # A record that is a bare value or list has "$" in place of an empty path.
                found |= {
                    path if path and not path.startswith("[") else f"${path}"
                    for kind, path in places
                    if kind in kinds and (kind != "empty" or path)
                }
            fresh = sorted(found - seen)
            seen.update(fresh)
            if fresh:
                yield pd.DataFrame({"path": fresh})

    return df.select(column).mapInPandas(run, "path string").distinct().orderBy("path")


def array_paths(payloads: DataFrame, column: str, sample: int | None = None) -> DataFrame:
    """Sorted paths whose value is a list, with ``[]`` for list elements.

    All elements of a list are looked at, or its first ``sample`` ones. NULL has no paths;
    text that is no JSON is an error.
    """
    return _paths(payloads, column, "$", ("list",), sample)


def field_paths(records: DataFrame, column: str, sample: int | None = None) -> DataFrame:
    """Sorted field paths of records: leaves, lists and empty objects.

    Pass all records, or only the first few in their own order to look at a sample. Lists,
    NULL and text that is no JSON are treated as in ``array_paths``.
    """
    return _paths(records, column, "", ("list", "leaf", "empty"), sample)


def first_records(records: DataFrame, order: str, count: int = 5) -> DataFrame:
    """The first records of a page, as a sample for ``field_paths``."""
    return records.orderBy(F.col(order)).limit(count)
