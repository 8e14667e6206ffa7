"""Run summaries, grader statistics and the weighted verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.numbers import exact_round


def has_error() -> Column:
    """A result failed when its error text is not empty."""
    return F.coalesce(F.col("error"), F.lit("")) != ""


def _whole_mean(total: Column, count: Column) -> Column:
    """Half-even integer mean."""
    return F.bround(total / F.greatest(count, F.lit(1)), 0).cast("long")


def mean_latency() -> Column:
    """Missing latency counts as zero and stays in the denominator."""
    return _whole_mean(F.sum(F.coalesce("latency_ms", F.lit(0))), F.count(F.lit(1)))


def mean_tokens(column: str) -> Column:
    """Only rows that report the counter take part; 0 when none does."""
    return F.coalesce(_whole_mean(F.sum(column), F.count(column)), F.lit(0))


def _stored_score() -> Column:
    """Mean score as stored: four decimals, 0 when nothing was scored."""
    return F.coalesce(exact_round(F.col("avg_score"), 4), F.lit(0.0))


def run_summary(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per run; a single partially aggregated shuffle."""
    keys = keys or ["eval_run_id"]
    passed = F.count_if(F.col("passed"))
    failed = F.count_if(~F.col("passed"))
    errors = F.count_if(has_error())
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        (passed + failed).alias("judged"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("passed").isNull() & ~has_error()).alias("unjudged"),
        errors.alias("errors"),
        (passed / F.greatest(passed + failed + errors, F.lit(1))).alias("accuracy"),
        F.avg("score").alias("avg_score"),
        mean_latency().alias("avg_latency_ms"),
        mean_tokens("input_tokens").alias("avg_input_tokens"),
        mean_tokens("output_tokens").alias("avg_output_tokens"),
    ).withColumn("avg_score", _stored_score())


def summary_of_sums(sums: DataFrame, score: Column) -> DataFrame:
    """The same summary from sums of each run: counts, ``latency``, tokens and the rows that report them.

    ``score`` is the sum of the finite scores; ``not_finite`` other scores make the mean NaN.
    """
    judged = F.col("passed") + F.col("failed")
    mean = F.when(F.col("not_finite") > 0, float("nan")).when(F.col("scored") > 0, score / F.col("scored"))
    return sums.select(
        "eval_run_id",
        "total",
        judged.alias("judged"),
        "passed",
        "failed",
        "unjudged",
        "errors",
        (F.col("passed") / F.greatest(judged + F.col("errors"), F.lit(1))).alias("accuracy"),
        mean.alias("avg_score"),
        _whole_mean(F.col("latency"), F.col("total")).alias("avg_latency_ms"),
        _whole_mean(F.col("input_tokens"), F.col("input_rows")).alias("avg_input_tokens"),
        _whole_mean(F.col("output_tokens"), F.col("output_rows")).alias("avg_output_tokens"),
    ).withColumn("avg_score", _stored_score())


SUMMARY_ZEROS = {
    "total": 0, "judged": 0, "passed": 0, "failed": 0, "unjudged": 0, "errors": 0,
    "accuracy": 0.0, "avg_score": 0.0, "avg_latency_ms": 0,
    "avg_input_tokens": 0, "avg_output_tokens": 0,
}


def summary_for_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Summary of every run; a run without results gets zeros."""
    ids = runs.select(F.col("id").alias("eval_run_id"))
    return ids.join(run_summary(results), "eval_run_id", "left").fillna(SUMMARY_ZEROS)


def explode_details(results: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the verdict map: one row per result and grader."""
    return results.select(*keys, F.explode("details").alias("grader", "verdict")).select(
        *keys, "grader", "verdict.*"
    )


def grader_stats(verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts, accuracy and mean score per run and grader.

    A grader that raised has ``passed = false`` and no score: it adds a failure
    but does not enter the mean.
    """
    keys = keys or ["eval_run_id"]
    passed = F.count_if(F.col("passed"))
    failed = F.count_if(~F.col("passed"))
    return verdicts.groupBy(*keys, "grader").agg(
        F.count(F.lit(1)).alias("total"),
        passed.alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("passed").isNull()).alias("unjudged"),
        (passed + failed).alias("judged"),
        (passed / F.greatest(passed + failed, F.lit(1))).alias("accuracy"),
        F.avg("score").alias("avg_score"),
    ).withColumn("avg_score", _stored_score())


def stats_as_map(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fold grader rows into one map per run (as many entries as the run has graders)."""
    keys = keys or ["eval_run_id"]
    fields = [c for c in stats.columns if c not in (*keys, "grader")]
    entry = F.struct("grader", F.struct(*fields))
    return stats.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(entry)).alias("grader_stats")
    )


def weighted_verdict(verdicts: Column) -> Column:
    """``struct(score, passed)`` from an array of verdict structs, without a shuffle.

    Only weights above zero count. A missing score (grader error) counts 0. The
    verdict is the conjunction of the known ones; with none it is NULL, or false
    when no weight is left at all.
    """
    active = F.filter(verdicts, lambda v: v["weight"] > 0)
    weight = F.aggregate(active, F.lit(0.0), lambda acc, v: acc + v["weight"])
    total = F.aggregate(
        active, F.lit(0.0), lambda acc, v: acc + v["weight"] * F.coalesce(v["score"], F.lit(0.0))
    )
    known = F.filter(active, lambda v: v["passed"].isNotNull())
    passed = (
        F.when(F.size(known) > 0, F.forall(known, lambda v: v["passed"]))
        .when(weight > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )
    return F.struct(
        F.when(weight > 0, total / weight).otherwise(F.lit(0.0)).alias("score"),
        passed.alias("passed"),
    )


def weighted_verdict_long(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The same verdict from the long form (one row per result and grader)."""
    active = F.col("weight") > 0
    weight = F.sum(F.when(active, F.col("weight")))
    total = F.sum(F.when(active, F.col("weight") * F.coalesce("score", F.lit(0.0))))
    return verdicts.groupBy(*keys).agg(
        F.coalesce(total / weight, F.lit(0.0)).alias("score"),
        F.coalesce(
            F.bool_and(F.when(active, F.col("passed"))),
            F.when(weight > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False)),
        ).alias("passed"),
    )


def distinct_graders(results: DataFrame) -> DataFrame:
    """Sorted grader names found in the verdict maps."""
    return results.select(F.explode(F.map_keys("details")).alias("grader")).distinct().orderBy("grader")


def first_weights(verdicts: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Weight of the first row that mentions a grader; 1 when it has none."""
    return verdicts.groupBy(*keys, "grader").agg(
        F.min_by(F.coalesce("weight", F.lit(1.0)), order).alias("weight")
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Whole percentage, halves rounded up."""
    return F.floor(done / F.greatest(total, F.lit(1)) * 100 + 0.5).cast("long")
