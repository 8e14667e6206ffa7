"""Joins: lookups, run views, referential maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    spread_by: list[str],
    target_rows: int | None = None,
) -> DataFrame:
    """Equi-join a large table to a lookup table.

    Spark broadcasts the lookup table when its statistics say that it is small, and
    AQE splits partitions that a hot key fills. With ``target_rows`` a key with more
    rows than that is spread in advance over rows / target_rows sub-keys, chosen by a
    hash of ``spread_by`` (repeatable when a task runs again); only the lookup rows of
    such keys are copied. That costs a pass over the keys and pays where AQE is off or
    the join is followed by work on the same partitions.
    """
    if target_rows is None:
        return facts.join(dim, on, how)
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > target_rows)
    hot = counts.select(*on, F.ceil(F.col("_rows") / target_rows).cast("int").alias("_salts"))
    salt = F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    left = facts.join(hot, on, "left").withColumn("_salt", salt)
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = dim.join(hot, on, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def run_view(
    runs: DataFrame, configs: DataFrame, datasets: DataFrame, *, how: str = "left", target_rows: int | None = None
) -> DataFrame:
    """Runs with the names of their config and dataset (NULL when dangling)."""
    names = configs.select(
        F.col("id").alias("eval_config_id"), F.col("name").alias("config_name")
    )
    sets = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    named = lookup_join(runs, names, ["eval_config_id"], how, spread_by=["id"], target_rows=target_rows)
    return lookup_join(named, sets, ["dataset_id"], how, spread_by=["id"], target_rows=target_rows)


def evaluation_rows(
    runs: DataFrame, dataset_rows: DataFrame, target_rows: int | None = None
) -> DataFrame:
    """One row per run and row of the run's dataset (the work list of a run)."""
    wanted = runs.select(F.col("id").alias("eval_run_id"), "dataset_id")
    return lookup_join(
        dataset_rows, wanted, ["dataset_id"], "inner", spread_by=["row_index"], target_rows=target_rows
    )


def _marked(
    children: DataFrame, deleted: DataFrame, key: str, parent_key: str, spread_by: list[str]
) -> DataFrame:
    """Children with ``_gone`` set where their parent is deleted."""
    gone = deleted.select(F.col(parent_key).alias(key)).distinct().withColumn("_gone", F.lit(True))
    return lookup_join(children, gone, [key], "left", spread_by=spread_by).select(
        *children.columns, "_gone"
    )


def delete_cascade(
    children: DataFrame, deleted: DataFrame, key: str, parent_key: str = "id", *, spread_by: list[str]
) -> DataFrame:
    """Children that remain after their parents in ``deleted`` are removed."""
    return _marked(children, deleted, key, parent_key, spread_by).filter("_gone IS NULL").drop("_gone")


def delete_restricted(parents: DataFrame, children: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Parents flagged ``blocked`` when a child still refers to them."""
    used = children.filter(F.col(key).isNotNull()).select(F.col(key).alias(parent_key)).distinct()
    return parents.join(used.withColumn("_used", F.lit(True)), parent_key, "left").withColumn(
        "blocked", F.coalesce("_used", F.lit(False))
    ).drop("_used")


def delete_set_null(
    children: DataFrame, deleted: DataFrame, key: str, parent_key: str = "id", *, spread_by: list[str]
) -> DataFrame:
    """Children whose reference to a deleted parent becomes NULL."""
    marked = _marked(children, deleted, key, parent_key, spread_by)
    return marked.withColumn(key, F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(key))).drop("_gone")
