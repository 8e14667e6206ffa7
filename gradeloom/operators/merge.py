"""Keyed unions: last write wins, baskets, appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write(
    writes: DataFrame, keys: list[str], arrival: Column, payload: list[str], first: list[str] | None = None
) -> DataFrame:
    """One row per key: ``payload`` of the last write, ``first`` columns of the earliest.

    Both come from one partially aggregated shuffle.
    """
    aggregates = [F.max_by(F.struct(*payload), arrival).alias("_last")]
    if first:
        aggregates.append(F.min_by(F.struct(*first), arrival).alias("_first"))
    merged = writes.groupBy(*keys).agg(*aggregates)
    return merged.select(*keys, *([F.col("_first.*")] if first else []), "_last.*")


def merge_basket(basket: DataFrame, items: DataFrame, key: str, position: str, payload: list[str]) -> DataFrame:
    """Items replace basket rows of the same key but keep the place of the first one."""
    both = basket.withColumn("_late", F.lit(0)).unionByName(items.withColumn("_late", F.lit(1)))
    arrival = F.struct("_late", position)
    return both.groupBy(key).agg(
        F.min(arrival).alias("_place"), F.max_by(F.struct(*payload), arrival).alias("_row")
    ).select(
        key, F.col("_place._late").alias("appended"), F.col(f"_place.{position}").alias(position), "_row.*"
    )


def remove_items(basket: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    return basket.join(selection.select(key).distinct(), key, "left_anti")


def count_selected(basket: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """How many of the listed selection ids are in the basket."""
    known = basket.select(key).distinct()
    return selection.join(known, key, "left_semi").agg(F.count(F.lit(1)).alias("selected"))


def first_seen(df: DataFrame, text: str, position: str) -> DataFrame:
    """Distinct texts with the place where each first appears."""
    return df.groupBy(text).agg(F.min(position).alias(position))


def append_rows(existing: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Union in dataset column order; absent cells become empty text."""

    def as_text(df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return df.select(
            *[
                (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in present else F.lit("")).alias(c)
                for c in columns
            ]
        )

    return as_text(existing).unionByName(as_text(rows))
