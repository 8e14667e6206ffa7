"""Runs whose heartbeat stops: keyed state with an event-time timeout.

The watermark plays the part of the clock. A run fails at its last heartbeat plus
the timeout, once; heartbeats after that are ignored, as is everything after the
run has ended by itself. Python sees times as microseconds, so no session time
zone gets in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.operators.browse import STALE_MESSAGE, STALE_MINUTES

TIMEOUT = STALE_MINUTES * 60 * 1_000_000
DAY = 24 * 3600 * 1_000_000
STATE = "closed boolean, starts array<long>, ends array<long>, ended_at long"

Span = tuple[int, int]


def _merge(spans: list[Span]) -> list[Span]:
    """Join spans whose gap is within the timeout."""
    merged: list[Span] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1] + TIMEOUT:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((start, end))
    return merged


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold the heartbeats of one Arrow batch into spans without a fatal gap.

    Runs before the shuffle, so a run that sends most heartbeats does not send
    them all to one task.
    """
    for batch in batches:
        beats = batch.sort_values(["eval_run_id", "at"])
        late = beats["at"].diff() > TIMEOUT
        other = beats["eval_run_id"] != beats["eval_run_id"].shift()
        beats = beats.assign(span=(late | other).cumsum())
        beats["stop"] = beats["at"].where(beats["ended"])
        yield beats.groupby("span").agg(
            eval_run_id=("eval_run_id", "first"),
            first_at=("at", "min"),
            last_at=("at", "max"),
            ended_at=("stop", "min"),
        ).astype({"ended_at": "Int64"})


def _watch(remembered: int) -> Callable:
    """State of a run: its spans while it is open; once it is closed, only when to forget it."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, starts, ends, ended_at = state.get if state.exists else (False, [], [], None)
        if closed and state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentWatermarkMs() * 1000

        def close(last: int) -> None:
            state.update((True, [], [last], None))
            state.setTimeoutTimestamp(max(last + remembered, now + 1000) // 1000)

        spans = [] if closed else list(zip(starts, ends, strict=True))
        for frame in frames:
            spans += zip(frame["first_at"].tolist(), frame["last_at"].tolist(), strict=True)
            stops = frame["ended_at"].dropna()
            if len(stops):
                first = int(stops.min())
                ended_at = first if ended_at is None else min(ended_at, first)
        last = max([b for _, b in spans] + (ends if closed else []))
        if closed:
            close(last)
            return
        spans = _merge(spans)
        deadline = spans[0][1] + TIMEOUT
        # A run that ended inside its first span never times out.
        finished = ended_at is not None and ended_at <= spans[0][1]
        if not finished and deadline > now:
            state.update((False, [a for a, _ in spans], [b for _, b in spans], ended_at))
            state.setTimeoutTimestamp(max(deadline // 1000, state.getCurrentWatermarkMs() + 1))
            return
        close(last)
        if not finished:
            yield pd.DataFrame({"eval_run_id": [key[0]], "last_at": [spans[0][1]], "failed_at": [deadline]})

    return run


def failed_runs(heartbeats: DataFrame, *, watermark: str, remember_days: float = 365) -> DataFrame:
    """Stream of runs that fell silent, from ``(eval_run_id, ts, ended)``.

    ``watermark`` is how late a heartbeat may arrive behind the newest one; choose it
    longer than the slowest delivery, as later ones are not seen and a run may then be
    reported although it went on. A run is reported when its deadline and this delay have
    passed; until then it stays open. A run that failed or ended is remembered, so that further
    heartbeats change nothing, until the watermark is ``remember_days`` past its last
    heartbeat; then its state goes, and a heartbeat would be a new run.
    """
    kind = heartbeats.schema["eval_run_id"].dataType.simpleString()
    beats = heartbeats.select(
        "eval_run_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.coalesce("ended", F.lit(False)).alias("ended"),
    )
    spans = beats.mapInPandas(
        _spans, f"eval_run_id {kind}, first_at long, last_at long, ended_at long"
    )
    timed = spans.withColumn("seen", F.timestamp_micros("last_at")).withWatermark("seen", watermark)
    failed = timed.groupBy("eval_run_id").applyInPandasWithState(
        _watch(int(remember_days * DAY)), f"eval_run_id {kind}, last_at long, failed_at long", STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return failed.select(
        "eval_run_id",
        F.lit("failed").alias("status"),
        F.timestamp_micros("last_at").alias("last_heartbeat"),
        F.timestamp_micros("failed_at").alias("failed_at"),
        F.lit(STALE_MESSAGE).alias("error_message"),
    )
