"""Running summaries and progress by change: a batch costs what it brings.

The rows of a run are cut into blocks of neighbouring row numbers, so that a run with most
of the rows is spread over all tasks. The state of a block holds the last figures of each
of its rows; a batch takes the old figures of its rows out and puts the new ones in, and
only the difference goes on. A summary is the sum of the differences. Scores are summed as
whole multiples of 2^-60, so what was put in is taken out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.operators.summary import has_error, summary_of_sums
from gradeloom.sources.keyed_table import KeyedTable

BLOCK_ROWS = 16_384
UNIT = 2.0**60  # a score of 1

# What a row adds to the sums of its run, and the bits in which its state keeps the yes and no of them.
COUNTS = ("passed", "failed", "errors", "unjudged", "scored", "input_rows", "output_rows", "not_finite")
AMOUNTS = ("latency", "input_tokens", "output_tokens")
FIGURES = ["row", "flags", *AMOUNTS, "score"]
SUMS = ["total", *COUNTS, *AMOUNTS]
BITS = np.arange(len(COUNTS))


def _figures(order: str) -> list[Column]:
    score = F.col("score").cast("double")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    conditions = {
        "passed": F.col("passed"),
        "failed": ~F.col("passed"),
        "errors": has_error(),
        "unjudged": F.col("passed").isNull() & ~has_error(),
        "scored": finite,
        "input_rows": F.col("input_tokens").isNotNull(),
        "output_rows": F.col("output_tokens").isNotNull(),
        "not_finite": score.isNotNull() & ~finite,
    }
    flags = sum((F.when(conditions[c], 1 << k).otherwise(0) for k, c in enumerate(COUNTS)), F.lit(0))
    amounts = {"latency": "latency_ms", "input_tokens": "input_tokens", "output_tokens": "output_tokens"}
    return [
        F.floor(F.col("row_index") / BLOCK_ROWS).cast("long").alias("block"),
        F.col("row_index").cast("long").alias("row"),
        F.col(order).alias("place"),
        flags.cast("long").alias("flags"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(a) for a, c in amounts.items()],
        F.when(finite, score).otherwise(0.0).alias("score"),
    ]


def _packed(frame: pd.DataFrame) -> np.ndarray:
    """A row of whole numbers for each result; the score by its bits."""
    score = frame["score"].to_numpy(np.float64).view(np.int64)
    return np.stack([*(frame[c].to_numpy(np.int64) for c in FIGURES[:-1]), score], axis=1)


def _last(frame: pd.DataFrame) -> np.ndarray:
    """The figures of each row; of repeats those that come last by ``place``, then by size."""
    if frame["row"].nunique(dropna=False) < len(frame):
        frame = frame.sort_values(["place", *FIGURES[1:]], na_position="first").drop_duplicates("row", keep="last")
    return _packed(frame)


def _sums(rows: np.ndarray) -> list[int]:
    scores = np.rint(np.ascontiguousarray(rows[:, -1]).view(np.float64) * UNIT)
    counts = (rows[:, 1:2] >> BITS & 1).sum(axis=0)
    return [len(rows), *counts.tolist(), *rows[:, 2:-1].sum(axis=0).tolist(), sum(map(int, scores.tolist()))]


def _change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    new = _last(parts[0] if len(parts) == 1 else pd.concat(parts))
    if state.exists:
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, len(FIGURES))
        again = np.isin(held[:, 0], new[:, 0])
        old, kept = _sums(held[again]), np.concatenate((held[~again], new))
    else:
        old, kept = [0] * (len(SUMS) + 1), new
    state.update((kept.tobytes(),))
    *sums, score = (b - a for a, b in zip(old, _sums(new), strict=True))
    yield pd.DataFrame({"eval_run_id": [key[0]], "sums": [sums], "score": [Decimal(score)]})


def changes(results: DataFrame, *, order: str) -> DataFrame:
    """Stream of differences of the sums of a run, from results of ``(eval_run_id, row_index)``.

    A row that comes again replaces the one before; of repeats inside a batch the one with
    the largest ``order`` counts, then the one with the largest figures.
    """
    kind = results.schema["eval_run_id"].dataType.simpleString()
    changed = results.select("eval_run_id", *_figures(order)).groupBy("eval_run_id", "block").applyInPandasWithState(
        _change, f"eval_run_id {kind}, sums array<long>, score decimal(38,0)", "rows binary", "update", GroupStateTimeout.NoTimeout
    )
    return changed.select("eval_run_id", *[F.col("sums")[k].alias(s) for k, s in enumerate(SUMS)], "score")


def _land(rows: DataFrame, target: str, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    """Add the differences of each batch up by run and write them as ``target/batch=N``."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        names = [c for c in batch.columns if c != "eval_run_id"]
        kinds = dict(batch.dtypes)
        sums = batch.groupBy("eval_run_id").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in names])
        sums.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = rows.writeStream.outputMode(mode).foreachBatch(commit).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_summary(
    results: DataFrame, target: str, checkpoint: str, *, order: str, available_now: bool = True
) -> StreamingQuery:
    """Summarise arriving results run by run, however late or often a row comes.

    Each batch reads and writes the state of the rows that it holds and lands one row of
    differences for each run that it touches; a replayed batch replaces its own folder.
    Read the summaries with ``latest_summary``. ``order`` decides between repeats of a row
    inside a batch; between batches the later one counts.
    """
    return _land(changes(results, order=order), target, checkpoint, "update", available_now)


def _summed(spark: SparkSession, target: str) -> DataFrame:
    landed = spark.read.parquet(target).drop("batch")
    kinds = dict(landed.dtypes)
    names = [c for c in landed.columns if c != "eval_run_id"]
    return landed.groupBy("eval_run_id").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in names])


def latest_summary(spark: SparkSession, target: str) -> DataFrame:
    """The summary of each run as of the last batch."""
    return summary_of_sums(_summed(spark, target), F.col("score").cast("double") / UNIT)


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the sums of all batches so far as the base of a new folder, read like the old one."""
    _summed(spark, target).write.mode("errorifexists").parquet(f"{compacted}/batch=-1")


def start_progress(
    spark: SparkSession, table: KeyedTable, target: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Count the committed rows of each run as batches of a keyed table land.

    Reads each file of the table once; a key that was there before, or twice, counts once.
    ``table`` has one batch at least. Read the counts with ``latest_progress``.
    """
    schema = [f for f in table.schema.fields if f.name in table.keys]
    keys = spark.readStream.schema(type(table.schema)(schema)).option("recursiveFileLookup", "true").parquet(table.path)
    new = keys.dropDuplicates(list(table.keys)).select("eval_run_id", F.lit(1).cast("long").alias("progress"))
    return _land(new, target, checkpoint, "append", available_now)


def latest_progress(spark: SparkSession, target: str) -> DataFrame:
    """Committed rows of each run as of the last batch."""
    return _summed(spark, target)
