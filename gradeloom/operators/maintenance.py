"""Table-maintenance jobs: legacy grader conversion, backfills, duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import strip

# Legacy comparer names that survive, with type and threshold.
LEGACY_GRADERS = {
    "semantic_similarity": ("semantic_similarity", 0.8),
    "json_schema_match": ("json_schema", 1.0),
    "json_field_match": ("json_field", 0.7),
}
CUSTOM_PREFIX = "custom:"


def _grader(name: Column, kind: Column, prompt: Column, threshold: Column, weight: Column) -> Column:
    return F.struct(
        name.alias("name"),
        kind.alias("type"),
        prompt.alias("prompt"),
        threshold.cast("double").alias("threshold"),
        weight.cast("double").alias("weight"),
    )


def unify_graders(comparers: Column, weights: Column, custom: Column) -> Column:
    """Grader list from a comma list of comparers, a weight map and custom graders.

    Unknown comparers drop out. A custom grader finds its weight under
    ``custom:<name>`` and otherwise keeps its own.
    """
    text = F.lit(None).cast("string")
    known = F.create_map(
        *[
            part
            for name, (kind, threshold) in LEGACY_GRADERS.items()
            for part in (F.lit(name), F.struct(F.lit(kind).alias("kind"), F.lit(threshold).alias("at")))
        ]
    )
    names = F.transform(F.split(F.coalesce(comparers, F.lit("")), ","), strip)
    kept = F.filter(names, lambda n: F.map_contains_key(known, n))
    built_in = F.transform(
        kept, lambda n: _grader(n, known[n]["kind"], text, known[n]["at"], weights[n])
    )
    own = F.transform(
        F.coalesce(custom, F.array().cast("array<struct<name:string,prompt:string,threshold:double,weight:double>>")),
        lambda g: _grader(
            g["name"],
            F.lit("prompt"),
            g["prompt"],
            g["threshold"],
            F.coalesce(
                weights[F.concat(F.lit(CUSTOM_PREFIX), strip(F.coalesce(g["name"], F.lit(""))))],
                g["weight"],
            ),
        ),
    )
    return F.concat(built_in, own)


def backfill_heartbeats(runs: DataFrame) -> DataFrame:
    """Fill a missing heartbeat from the start or creation time."""
    return runs.withColumn("heartbeat_at", F.coalesce("heartbeat_at", "started_at", "created_at"))


def duplicate_parents(parents: DataFrame, new_id: Column, **reset: Column) -> DataFrame:
    """Copies with a new id and `` copy`` after the name; ``reset`` overrides columns.

    ``new_id`` must be a function of the row (not ``uuid()``), so that children
    copied in another job still find their parent.
    """
    copies = parents.withColumn("_new", new_id).withColumn(
        "name", F.concat("name", F.lit(" copy"))
    )
    for column, value in reset.items():
        copies = copies.withColumn(column, value)
    return copies.withColumn("id", F.col("_new")).drop("_new")


def duplicate_children(
    children: DataFrame, parents: DataFrame, key: str, new_parent: Column, new_id: Column
) -> DataFrame:
    """Copies of the children of ``parents`` that point at the copied parents."""
    mapping = parents.select(F.col("id").alias(key), new_parent.alias("_parent"))
    copied = children.join(mapping, key)
    return copied.withColumn("_id", new_id).withColumn(key, F.col("_parent")).withColumn(
        "id", F.col("_id")
    ).drop("_id", "_parent")
