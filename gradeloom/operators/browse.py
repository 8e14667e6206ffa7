"""Search, filters, paging, status labels and audits over the entity tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import list_as_text, matches_any, search_pattern
from gradeloom.operators.ordinals import number_sorted

# Fixed values shared by run monitoring and listing.
ACTIVE_STATUSES = ("pending", "running", "finalizing")
STALE_MINUTES = 30
STALE_MESSAGE = "Run heartbeat expired before completion. Partial results were saved."
GRADER_TYPES = (
    "prompt", "string_check", "python", "semantic_similarity", "json_schema", "json_field",
)
DEFAULT_THRESHOLDS = {"semantic_similarity": 0.8, "json_schema": 1.0}
DEFAULT_THRESHOLD = 0.7
DEFAULT_PAGE_SIZE = 10
MAX_PAGE_SIZE = 100


def _searched(df: DataFrame, columns: list[Column], search: str | None, escape: bool) -> DataFrame:
    pattern = search_pattern(search, escape=escape)
    return df if pattern is None else df.filter(matches_any(columns, pattern))


def search_configs(
    configs: DataFrame,
    search: str | None = None,
    tags: list[str] | None = None,
    *,
    escape: bool = False,
    whole_tags: bool = False,
) -> DataFrame:
    """Configs that match the text in any of five fields and any of the tags.

    Tags match as substrings of the serialised list (``prod`` also finds
    ``production``) unless ``whole_tags`` asks for whole tags.
    """
    fields = [F.col(c) for c in ("name", "comment", "system_prompt", "model")]
    found = _searched(configs, [*fields, list_as_text(F.col("tags"))], search, escape)
    wanted = [t.strip() for t in tags or [] if t.strip()]
    if not wanted:
        return found
    if whole_tags:
        return found.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))
    text = list_as_text(F.col("tags"))
    hits = [matches_any([text], f"%{t.lower()}%".replace("\\", "\\\\")) for t in wanted]
    return found.filter(reduce(or_, hits))


def search_datasets(datasets: DataFrame, search: str | None, *, escape: bool = False) -> DataFrame:
    fields = [F.col("name"), F.col("file_path"), list_as_text(F.col("columns"))]
    return _searched(datasets, fields, search, escape)


def search_runs(view: DataFrame, search: str | None, *, escape: bool = False) -> DataFrame:
    """Search a run view by id, status and the joined names."""
    fields = [F.col("id").cast("string"), F.col("status"), F.col("config_name"), F.col("dataset_name")]
    return _searched(view, fields, search, escape)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def check_page(number: int, size: int) -> None:
    if not 1 <= size <= MAX_PAGE_SIZE or number < 1:
        raise ValueError(f"page starts at 1 and page_size lies in 1..{MAX_PAGE_SIZE}")


def page(df: DataFrame, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page, newest first.

    A page near the front is a top-k; a deep page would pull everything before
    it into one task, so it is cut out by position instead, with the same rows. To walk
    through many pages use ``page_after``, which is a top-k at any depth, or ``page_index``.
    """
    check_page(number, size)
    start = (number - 1) * size
    if start + size <= 10_000:
        return newest_first(df).offset(start).limit(size)
    placed = number_sorted(df, [F.desc("created_at"), F.desc("id")], "_position")
    return newest_first(
        placed.filter((F.col("_position") >= start) & (F.col("_position") < start + size))
    ).drop("_position")


def page_after(df: DataFrame, created_at: Column, id_: Column, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page that follows the row with ``created_at`` and ``id_``, newest first.

    Rows without a time come last, as in ``newest_first``.
    """
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size lies in 1..{MAX_PAGE_SIZE}")
    older = F.col("created_at").isNull() & created_at.isNotNull() | (F.col("created_at") < created_at)
    same = F.col("created_at").eqNullSafe(created_at) & (F.col("id") < id_)
    return newest_first(df.filter(F.coalesce(older, F.lit(False)) | F.coalesce(same, F.lit(False)))).limit(size)


def page_counts(total: Column, size: Column) -> Column:
    """Number of pages, at least one."""
    return F.greatest(F.ceil(total / size), F.lit(1)).cast("long")


def result_status(passed: Column, error: Column) -> Column:
    """Badge of a result: an error wins over any verdict."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "Error")
        .when(passed, "Pass")
        .when(~passed, "Fail")
        .otherwise("Score only")
    )


def failed_only(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("passed"))


def below_threshold(accuracy: Column, minimum: Column) -> Column:
    """Strictly below an existing threshold."""
    return F.coalesce(accuracy < minimum, F.lit(False))


def is_stale(now: Column) -> Column:
    """Active run whose last sign of life is older than the timeout."""
    alive = F.coalesce("heartbeat_at", "created_at")
    cutoff = now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    return F.col("status").isin(*ACTIVE_STATUSES) & (alive < cutoff)


def fail_stale(runs: DataFrame, now: Column) -> DataFrame:
    """Move stale runs to ``failed``; a projection, no shuffle."""
    stale = F.coalesce(is_stale(now), F.lit(False))
    return (
        runs.withColumn("_stale", stale)
        .withColumn("status", F.when(F.col("_stale"), "failed").otherwise(F.col("status")))
        .withColumn("error_message", F.when(F.col("_stale"), STALE_MESSAGE).otherwise(F.col("error_message")))
        .withColumn("completed_at", F.when(F.col("_stale"), now).otherwise(F.col("completed_at")))
        .withColumn("heartbeat_at", F.when(F.col("_stale"), now).otherwise(F.col("heartbeat_at")))
        .drop("_stale")
    )


def grader_rank(passed: Column, pass_first: bool = False) -> Column:
    """Sort rank of a verdict: failures (or passes) first, unknown always last."""
    first, second = (0, 1) if pass_first else (1, 0)
    return F.when(passed, first).when(~passed, second).otherwise(2)


def sort_by_grader(results: DataFrame, grader: str, *, pass_first: bool = False) -> DataFrame:
    verdict = F.col("details")[grader]["passed"]
    return results.orderBy("eval_run_id", grader_rank(verdict, pass_first), "row_index")


def grader_violations(graders: Column) -> Column:
    """Names of the rules a grader list breaks (empty when it is valid)."""
    names = F.transform(graders, lambda g: g["name"])
    bad_weight = F.exists(graders, lambda g: ~F.coalesce(g["weight"], F.lit(1.0)).between(0, 1))
    bad_type = F.exists(graders, lambda g: ~F.coalesce(g["type"], F.lit("prompt")).isin(*GRADER_TYPES))
    no_schema = F.exists(graders, lambda g: (g["type"] == "json_schema") & g["schema"].isNull())
    rules = [
        (F.coalesce(F.size(graders), F.lit(0)) <= 0, "no_graders"),
        (F.size(F.array_distinct(names)) < F.size(names), "duplicate_names"),
        (bad_weight, "weight_out_of_range"),
        (bad_type, "unknown_type"),
        (no_schema, "schema_missing"),
    ]
    found = F.array(*[F.when(F.coalesce(hit, F.lit(False)), F.lit(rule)) for hit, rule in rules])
    return F.array_compact(found)


def default_threshold(kind: Column) -> Column:
    """Threshold of a grader definition that leaves the key out."""
    picked = F.lit(DEFAULT_THRESHOLD)
    for name, value in DEFAULT_THRESHOLDS.items():
        picked = F.when(kind == name, F.lit(value)).otherwise(picked)
    return picked


def mapping_violations(mapping: Column) -> Column:
    """Rules a field mapping breaks: both required columns, no empty key or value."""
    missing = [
        (~F.map_contains_key(mapping, name), f"missing_{name}") for name in ("input", "expected_output")
    ]
    blank_key = F.exists(F.map_keys(mapping), lambda k: k == "")
    blank_value = F.exists(F.map_values(mapping), lambda v: F.coalesce(v, F.lit("")) == "")
    rules = [*missing, (blank_key, "empty_key"), (blank_value, "empty_value")]
    return F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for hit, rule in rules]))
