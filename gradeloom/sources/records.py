"""Records from JSON payloads, dataset rows from records, and appends to datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.mapping import Value, as_text, map_records, path_steps, resolve
from gradeloom.operators.joins import lookup_join
from gradeloom.operators.merge import append_rows

REQUIRED_COLUMNS = ("input", "expected_output")


def extract_records(df: DataFrame, payload: Value, path: str | None, keep: list[str]) -> DataFrame:
    """One row per element of the list at ``path``: ``keep``, ``record_index``, ``record``.

    A path that is missing in a payload yields no rows; a value of another kind and
    payload text that is no JSON are errors (found while planning when the schema
    already says so).
    """
    if not path:
        raise ValueError("records_path must not be empty")
    found = resolve(payload, path_steps(path))
    if isinstance(found.type, T.NullType):
        return df.select(*keep, F.lit(0).alias("record_index"), F.lit(None).cast("string").alias("record")).limit(0)
    if not found.is_list:
        raise ValueError("records_path must resolve to a list")
    return df.select(*keep, F.posexplode(_checked(payload, found)).alias("record_index", "record"))


def _checked(payload: Value, found: Value) -> Column:
    """The list of a payload that was read from text; where there is none, the text is looked at."""
    if payload.raw is None:
        return found.col
    text, _ = payload.raw
    problem = F.when(text.isNotNull() & F.get_json_object(text, "$").isNull(), "payload is no JSON")
    if found.raw is not None:
        here = F.get_json_object(*found.raw)
        problem = F.coalesce(problem, F.when(here.isNotNull() & ~here.startswith("["), "records_path must resolve to a list"))
    stopped = F.when(problem.isNotNull(), F.raise_error(problem)).cast(found.type)
    return F.coalesce(found.col, stopped)


def extract_json_records(df: DataFrame, column: str, path: str, keep: list[str]) -> DataFrame:
    """The same for payload text without a schema; records stay JSON text.

    A payload that is no JSON or whose value at ``path`` is no list stops the job, as
    reading it would lose data silently.
    """
    steps = path_steps(path)
    if None in steps:
        raise ValueError("wildcard paths need a declared schema")
    where = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    text = F.get_json_object(F.col(column), where)
    items = F.from_json(text, "array<string>")
    problem = F.when(text.isNotNull() & ~text.startswith("["), "records_path must resolve to a list").when(
        text.isNull() & F.col(column).isNotNull() & F.get_json_object(F.col(column), "$").isNull(), "payload is no JSON"
    )
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("array<string>")).otherwise(items)
    return df.select(*keep, F.posexplode(checked).alias("record_index", "record"))


def check_mapping(mapping: dict[str, str]) -> None:
    """The dataset contract of a mapping."""
    if any(name not in mapping for name in REQUIRED_COLUMNS):
        raise ValueError("Field mapping must include input and expected_output")
    if any(not key or not value for key, value in mapping.items()):
        raise ValueError("Field mapping keys and values must be non-empty")


def import_settings(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Source, path and mapping of each import: its preset's when it names one, else its own."""
    fields = ("data_source_id", "records_path", "field_mapping")
    saved = presets.select(F.col("id").alias("preset_id"), F.struct(*fields).alias("_preset"))
    joined = lookup_join(requests, saved, ["preset_id"], "left", spread_by=["id"])
    chosen = [
        F.when(F.col("preset_id").isNotNull(), F.col("_preset")[f]).otherwise(F.col(f)).alias(f)
        for f in fields
    ]
    rest = [c for c in requests.columns if c not in fields]
    return joined.select(*rest, *chosen)


def import_snapshot(source_id: str, records_path: str, mapping: dict[str, str]) -> dict:
    """What an imported dataset remembers about its source, frozen at import."""
    return {"data_source_id": source_id, "records_path": records_path, "field_mapping": dict(mapping)}


def import_rows(
    df: DataFrame, record: Value, snapshot: dict, columns: list[str] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """Dataset rows of selected records under a snapshot's mapping."""
    mapping = snapshot.get("field_mapping")
    if not isinstance(mapping, dict):
        raise ValueError("Dataset import mapping is invalid")
    check_mapping(mapping)
    return map_records(df, record, mapping, columns, keep)


def append_from_source(
    rows: DataFrame, columns: list[str], snapshot: dict | None, df: DataFrame, record: Value
) -> DataFrame:
    """Existing rows plus newly mapped ones.

    The mapping is the snapshot's, whatever the preset says today; a dataset
    without a snapshot cannot continue an import.
    """
    if not isinstance(snapshot, dict):
        raise ValueError("Dataset does not support continuing import")
    return append_rows(rows, import_rows(df, record, snapshot, columns), columns)


def ready_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pre-mapped rows as text in dataset order; every column must be there."""
    if any(not c for c in columns):
        raise ValueError("Dataset columns are invalid")
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"Selected rows must include every dataset column: {', '.join(missing)}")
    return df.select(*[F.coalesce(_as_stored(df, c), F.lit("")).alias(c) for c in columns])


def _as_stored(df: DataFrame, column: str) -> Column:
    return as_text(Value(F.col(column), df.schema[column].dataType))


def explore_settings(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Path and mapping of each request: its own, else its preset's."""
    saved = presets.select(
        F.col("id").alias("preset_id"),
        F.col("records_path").alias("_path"),
        F.col("field_mapping").alias("_mapping"),
    )
    return (
        lookup_join(requests, saved, ["preset_id"], "left", spread_by=["id"])
        .withColumn("records_path", F.coalesce("records_path", "_path"))
        .withColumn("field_mapping", F.coalesce("field_mapping", "_mapping"))
        .drop("_path", "_mapping")
    )
