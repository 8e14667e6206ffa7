"""Side-by-side comparison of two runs, and row-level differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.ordinals import with_ordinal

SHOWN = ("actual_output", "score", "passed", "error")


def winner(score_a: Column, score_b: Column) -> Column:
    """A, B or Tie; NULL when a score is missing."""
    return F.when(score_a > score_b, "A").when(score_b > score_a, "B").when(score_a == score_b, "Tie")


def compare_runs(
    side_a: DataFrame, side_b: DataFrame, keys: list[str], *, by_position: bool = True
) -> DataFrame:
    """Pair the rows of run A with those of run B; A drives, missing B is NULL.

    ``keys`` name the comparison (so many pairs run in one job). Rows pair by
    their position in ``row_index`` order, or by ``row_index`` itself.
    """
    pair = "_position" if by_position else "row_index"
    if by_position:
        side_a = with_ordinal(side_a, keys, "row_index", pair)
        side_b = with_ordinal(side_b, keys, "row_index", pair)
    left = side_a.select(
        *keys,
        *([pair, "row_index"] if by_position else [pair]),
        "input_data",
        "expected_output",
        *[F.col(c).alias(f"{c}_a") for c in SHOWN],
    )
    right = side_b.select(
        *keys, pair, F.lit(True).alias("in_b"), *[F.col(c).alias(f"{c}_b") for c in SHOWN]
    )
    joined = left.join(right, [*keys, pair], "left").withColumn(
        "in_b", F.coalesce("in_b", F.lit(False))
    )
    if by_position:
        joined = joined.drop(pair)
    return joined.withColumn("winner", winner(F.col("score_a"), F.col("score_b")))


def comparison_totals(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Wins, ties and undecided rows per pair of runs."""
    return compared.groupBy(*keys).agg(
        F.count_if(F.col("winner") == "A").alias("a_wins"),
        F.count_if(F.col("winner") == "B").alias("b_wins"),
        F.count_if(F.col("winner") == "Tie").alias("ties"),
        F.count_if(F.col("winner").isNull()).alias("undecided"),
    )


def _digest(field: str) -> Column:
    """What equal texts share: the length in bytes, and the text or, of a long one, its SHA-256."""
    text = F.coalesce(F.col(field), F.lit("")).cast("string")
    size = F.octet_length(text)
    return F.struct(size, F.when(size > 64, F.sha2(text, 256)).otherwise(text))


def changed_fields(original: DataFrame, translated: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows flagged ``changed`` when any field differs; NULL equals empty text.

    Long texts are compared by their SHA-256, so that none goes through the join.
    """
    sides = [
        side.select(*key, *[_digest(f).alias(f"_{mark}{i}") for i, f in enumerate(fields)])
        for mark, side in (("a", original), ("b", translated))
    ]
    joined = sides[0].join(sides[1], key)
    differs = [F.col(f"_a{i}") != F.col(f"_b{i}") for i in range(len(fields))]
    flags = F.array(*[F.when(d, F.lit(f)) for d, f in zip(differs, fields, strict=True)])
    return joined.select(
        *key,
        (F.size(F.array_compact(flags)) > 0).alias("changed"),
        F.array_join(F.array_compact(flags), ",").alias("changed_fields"),
    )
