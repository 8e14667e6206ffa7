"""Incremental grading into a keyed table, its progress, and summaries over deduplicated streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.operators.summary import progress_percent, run_summary
from gradeloom.sources.keyed_table import KeyedTable


def start_grading(
    outputs: DataFrame,
    grade: Callable[[DataFrame], DataFrame],
    table: KeyedTable,
    checkpoint: str,
    *,
    order: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Grade arriving outputs and upsert them by run and row.

    Of repeats inside a batch the one with the largest ``order`` counts, between batches the
    later one. A batch that is replayed after a failure replaces its own partition of the
    table, so nothing counts twice. ``run_progress`` counts what is committed when somebody
    asks; ``running.start_progress`` counts along.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        table.upsert(grade(batch), batch_id, order)

    writer = outputs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_progress(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """Committed rows per run, from the keys of the table alone."""
    keys = table.writes(spark).select(*table.keys).distinct()
    return keys.groupBy("eval_run_id").agg(F.count(F.lit(1)).alias("progress"))


def progress_view(progress: DataFrame, runs: DataFrame) -> DataFrame:
    """Progress with the total and the percentage of each run."""
    joined = runs.select("eval_run_id", "total_rows").join(progress, "eval_run_id", "left")
    done = F.coalesce("progress", F.lit(0))
    return joined.select(
        "eval_run_id",
        done.alias("progress"),
        "total_rows",
        progress_percent(done, F.col("total_rows")).alias("percent"),
    )


def deduplicated(results: DataFrame, *, watermark: str, time: str = "created_at") -> DataFrame:
    """Drop repeated (run, row) results that arrive within the watermark."""
    return results.withWatermark(time, watermark).dropDuplicatesWithinWatermark(
        ["eval_run_id", "row_index"]
    )


def streaming_summary(results: DataFrame, *, watermark: str, time: str = "created_at") -> DataFrame:
    """Running summary with bounded state, over deduplicated results (update mode).

    Rows later than ``watermark`` are left out; ``running.start_summary`` leaves out none.

    Counts combine before the shuffle, so a run that sends most rows costs each
    task one row. The exact score rounding applies to the running mean.
    """
    return run_summary(deduplicated(results, watermark=watermark, time=time))
