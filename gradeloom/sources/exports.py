"""Wide export of run results: fixed columns plus four per grader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.json_text import bool_text, canonical_json, datetime_text, quoted
from gradeloom.functions.numbers import float_text
from gradeloom.functions.text import grader_key
from gradeloom.operators.joins import lookup_join
from gradeloom.operators.summary import distinct_graders

# The export columns, in file order.
RUN_COLUMNS = (
    "run_id", "run_status", "config_name", "dataset_name", "run_created_at", "run_started_at",
    "run_completed_at", "run_summary_json",
)
RESULT_COLUMNS = (
    "result_id", "row_index", "input_data", "expected_output", "actual_output", "passed",
    "comparer_score", "latency_ms", "input_tokens", "output_tokens", "error",
    "comparer_details_json", "token_usage_json", "result_created_at",
)
GRADER_COLUMNS = ("score", "passed", "reasoning", "details_json")


def enrich_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results with the columns of their run."""
    return lookup_join(results, runs, ["eval_run_id"], "inner", spread_by=["result_id"])


def grader_names(results: DataFrame) -> list[str]:
    """Sorted grader names of a result set (a handful of names reaches the driver)."""
    return [row["grader"] for row in distinct_graders(results).collect()]


def key_collisions(names: DataFrame, column: str = "grader") -> DataFrame:
    """Export prefixes that several grader names share; the last name wins in the file."""
    return names.groupBy(grader_key(F.col(column)).alias("grader_key")).agg(
        F.count_distinct(column).alias("names")
    ).filter("names > 1")


def run_export(
    results: DataFrame, runs: DataFrame, names: list[str] | None = None, *, names_from: DataFrame | None = None
) -> DataFrame:
    """One text row per result.

    ``runs`` is a run view with a ``summary`` struct; ``results`` carry
    ``result_id`` and the verdict map. The columns are those of ``names``, else of all names
    in ``names_from`` (the plain results table when ``results`` is already a join); the
    whole map is in ``comparer_details_json`` either way. Columns come from map lookups, so
    no pivot shuffles the rows.
    """
    names = sorted(names) if names is not None else grader_names(results if names_from is None else names_from)
    summary_type = runs.schema["summary"].dataType
    details_type = results.schema["details"].dataType
    verdict_type = details_type.valueType
    run_side = runs.select(
        F.col("id").alias("eval_run_id"),
        F.col("id").cast("string").alias("run_id"),
        F.col("status").alias("run_status"),
        "config_name",
        "dataset_name",
        datetime_text(F.col("created_at")).alias("run_created_at"),
        datetime_text(F.col("started_at")).alias("run_started_at"),
        datetime_text(F.col("completed_at")).alias("run_completed_at"),
        canonical_json(F.col("summary"), summary_type).alias("run_summary_json"),
    )
    rows = enrich_results(results, run_side)
    # A grader's own keys stand beside its score, threshold and name.
    style = {"null_keys": ("passed", "threshold"), "merge_key": "details_json"}
    verdicts = {name: f"_verdict{i}" for i, name in enumerate(names)}
    rows = rows.select("*", *[F.col("details")[n].alias(c) for n, c in verdicts.items()])
    rows = rows.select(
        "*", *[canonical_json(F.col(c), verdict_type, **style).alias(f"{c}_json") for c in verdicts.values()]
    )
    # Names with a column have their text already; all others are written from the map.
    made_texts = F.create_map(*[x for n, c in verdicts.items() for x in (F.lit(n), F.col(f"{c}_json"))]) if verdicts else None
    keys = F.array_sort(F.map_keys("details"))

    def entry(name: Column) -> Column:
        text = canonical_json(F.col("details")[name], verdict_type, **style)
        text = text if made_texts is None else F.coalesce(made_texts[name], text)
        return F.concat(quoted(name), F.lit(": "), text)

    whole = F.when(
        F.col("details").isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", F.transform(keys, entry)), F.lit("}"))
    )
    usage = F.when(
        F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(),
        F.to_json(F.struct("input_tokens", "output_tokens")),
    )
    spaced = F.regexp_replace(F.regexp_replace(usage, ":", ": "), ",", ", ")
    made = {name: F.col(name) for name in RUN_COLUMNS}
    made |= {
        "result_id": F.col("result_id").cast("string"),
        "row_index": F.col("row_index").cast("string"),
        "input_data": F.col("input_data"),
        "expected_output": F.col("expected_output"),
        "actual_output": F.col("actual_output"),
        "passed": bool_text(F.col("passed")),
        "comparer_score": float_text(F.col("score")),
        "latency_ms": F.col("latency_ms").cast("string"),
        "input_tokens": F.col("input_tokens").cast("string"),
        "output_tokens": F.col("output_tokens").cast("string"),
        "error": F.col("error"),
        "comparer_details_json": whole,
        "token_usage_json": spaced,
        "result_created_at": datetime_text(F.col("created_at")),
    }
    fields = verdict_type.fieldNames()
    for name in names:
        verdict = F.col(verdicts[name])
        prefix = _key(name)
        made[f"{prefix}_score"] = float_text(verdict["score"])
        made[f"{prefix}_passed"] = bool_text(verdict["passed"])
        reasoning = verdict["reasoning"] if "reasoning" in fields else F.lit(None).cast("string")
        made[f"{prefix}_reasoning"] = reasoning
        made[f"{prefix}_details_json"] = F.col(f"{verdicts[name]}_json")
    return rows.select(*[F.coalesce(col, F.lit("")).alias(name) for name, col in made.items()])


def _key(name: str) -> str:
    """Driver-side twin of ``grader_key`` for column names."""
    return "grader_" + (re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_").lower() or "unknown")


def write_export(export: DataFrame, path: str) -> None:
    """Write the export as CSV part files; quoting survives line breaks in cells."""
    export.write.mode("overwrite").options(
        header="true", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)
