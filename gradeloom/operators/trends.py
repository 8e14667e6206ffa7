"""Latest and previous runs of a schedule, trend deltas and alert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.numbers import fixed_text
from gradeloom.functions.text import magnitude_text, percent_text
from gradeloom.operators.browse import below_threshold
from gradeloom.operators.joins import lookup_join
from gradeloom.operators.ordinals import with_neighbour

# Fixed values of the alert text.
FLAT = "•"
UP, DOWN = "▲", "▼"
GOOD, BAD = "🟢", "🔴"
ALERT_BAD, ALERT_OK = "🚨", "✅"
DASH = "—"


def latest_run(runs: DataFrame, key: str = "scheduled_by_id") -> DataFrame:
    """Newest run of each schedule by creation time, then id.

    ``max_by`` combines on the map side, so a schedule that owns most runs sends
    one row per input partition. All columns of ``runs`` travel with the newest
    run: select what is needed first.
    """
    newest = F.max_by(F.struct(*runs.columns), F.struct("created_at", "id"))
    return (
        runs.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(newest.alias("_run"))
        .select("_run.*")
    )


def previous_completed(runs: DataFrame, columns: list[str], key: str = "scheduled_by_id") -> DataFrame:
    """Completed scheduled runs with struct ``previous`` of the one finished before.

    A busy schedule is cut into pieces of its own; order is completion time, then id.
    """
    done = runs.filter((F.col("status") == "completed") & F.col(key).isNotNull())
    return with_neighbour(done, [key], ["completed_at", "id"], columns, "previous")


def delta_text(
    delta: Column, *, unit: str, scale: float = 1, decimals: int = 1, higher_is_better: bool = True
) -> Column:
    """Signed change with a direction arrow and a colour; a dot when it rounds to nothing."""
    scaled = delta * F.lit(float(scale))
    improving = (delta > 0) == F.lit(higher_is_better)
    text = F.concat(
        F.when(improving, GOOD).otherwise(BAD),
        F.lit(" "),
        F.when(delta > 0, UP).otherwise(DOWN),
        F.lit(" "),
        F.when(scaled > 0, "+").otherwise("-"),
        magnitude_text(scaled, decimals),
        F.lit(unit),
    )
    return F.when(F.abs(scaled) < F.lit(10 ** (-decimals) / 2), FLAT).otherwise(text)


def delta_direction(delta: Column, *, scale: float, decimals: int) -> Column:
    flat = F.abs(delta * F.lit(float(scale))) < F.lit(10 ** (-decimals) / 2)
    return F.when(delta.isNull(), F.lit(None)).when(flat, "flat").when(delta > 0, "up").otherwise("down")


def _with_delta(text: Column, delta: Column) -> Column:
    return F.when(delta.isNull(), text).otherwise(F.concat(text, F.lit(" "), delta))


def trend(pairs: DataFrame) -> DataFrame:
    """Deltas and display text for rows with ``previous`` (accuracy, score, latency)."""
    deltas = pairs.select(
        "*",
        (F.col("accuracy") - F.col("previous.accuracy")).alias("accuracy_delta"),
        (F.col("avg_score") - F.col("previous.avg_score")).alias("score_delta"),
        (F.col("avg_latency_ms") - F.col("previous.avg_latency_ms")).alias("latency_delta"),
    )
    accuracy, score, latency = (F.col(c) for c in ("accuracy_delta", "score_delta", "latency_delta"))
    return deltas.select(
        "*",
        delta_direction(accuracy, scale=100, decimals=1).alias("accuracy_trend"),
        delta_direction(score, scale=1, decimals=3).alias("score_trend"),
        delta_direction(latency, scale=1, decimals=1).alias("latency_trend"),
        F.coalesce(
            _with_delta(percent_text(F.col("accuracy")), delta_text(accuracy, unit="pp", scale=100)),
            F.lit(DASH),
        ).alias("accuracy_text"),
        F.coalesce(
            _with_delta(fixed_text(F.col("avg_score"), 3), delta_text(score, unit="", decimals=3)),
            F.lit(DASH),
        ).alias("score_text"),
        F.coalesce(
            _with_delta(
                F.concat(F.col("avg_latency_ms").cast("long").cast("string"), F.lit(" ms")),
                delta_text(latency, unit="ms", higher_is_better=False),
            ),
            F.lit(DASH),
        ).alias("latency_text"),
    )


def alert_table(
    runs: DataFrame, schedules: DataFrame, configs: DataFrame, datasets: DataFrame, base_url: str = ""
) -> DataFrame:
    """One alert per completed scheduled run: header, fields and threshold note as JSON text.

    ``runs`` carry the summary columns (accuracy, avg_score, avg_latency_ms,
    passed, failed, errors).
    """
    pairs = trend(previous_completed(runs, ["accuracy", "avg_score", "avg_latency_ms"]))
    plans = schedules.select(
        F.col("id").alias("scheduled_by_id"), F.col("name").alias("schedule_name"), "min_accuracy"
    )
    names = configs.select(F.col("id").alias("eval_config_id"), F.col("name").alias("config_name"))
    sets = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    joined = lookup_join(pairs, plans, ["scheduled_by_id"], "inner", spread_by=["id"])
    joined = lookup_join(joined, names, ["eval_config_id"], spread_by=["id"])
    joined = lookup_join(joined, sets, ["dataset_id"], spread_by=["id"])
    low = below_threshold(F.col("accuracy"), F.col("min_accuracy"))
    counts = F.concat_ws(
        " / ", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("passed", "failed", "errors")]
    )
    context = F.concat(
        F.lit("*Config:* "), F.coalesce("config_name", F.lit(DASH)),
        F.lit("    *Dataset:* "), F.coalesce("dataset_name", F.lit(DASH)),
    )
    note = F.concat(
        F.lit("\n⚠️ Accuracy below threshold ("), percent_text(F.col("min_accuracy")), F.lit(")")
    )
    fields = [
        ("Accuracy", F.col("accuracy_text")),
        ("Avg Score", F.col("score_text")),
        ("Avg Latency", F.col("latency_text")),
        ("Passed / Failed / Errors", counts),
    ]
    field_column = F.array(
        *[
            F.struct(F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}*\n"), text).alias("text"))
            for label, text in fields
        ]
    )
    header = F.concat(F.when(low, ALERT_BAD).otherwise(ALERT_OK), F.lit(" "), F.col("schedule_name"))
    link = F.concat(F.lit(base_url.rstrip("/") + "/runs/"), F.col("id").cast("string"))
    message = F.struct(
        header.alias("header"),
        F.when(low, F.concat(context, note)).otherwise(context).alias("context"),
        field_column.alias("fields"),
        (link if base_url else F.lit(None).cast("string")).alias("url"),
    )
    return joined.select(
        F.col("id").alias("run_id"),
        "scheduled_by_id",
        low.alias("below_threshold"),
        header.alias("header"),
        "accuracy_text",
        "score_text",
        "latency_text",
        counts.alias("counts_text"),
        F.to_json(message).alias("message"),
    )
