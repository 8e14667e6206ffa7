"""Pages at any depth from a table that is sorted and cut into ranges once.

``browse.page`` sorts again for each page. Where many pages of one state of a table are
asked for, write the ranges with their positions once; a page then reads only the ranges
that hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.operators.browse import DEFAULT_PAGE_SIZE, check_page

# The id of a row holds the range above this bit and the place in the range below.
PLACE_BITS = 33


def write_page_index(df: DataFrame, path: str) -> None:
    """Write ``df`` newest first, in ranges that Spark samples; ``path`` must not be what ``df`` reads.

    Rows without a time come last, rows that are equal in time and id stand in any order.
    """
    order = [F.desc("created_at"), F.desc("id")]
    mark = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", mark)
    placed = ranged.select(
        *df.columns,
        F.shiftright("_mark", PLACE_BITS).alias("_range"),
        F.col("_mark").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"),
    )
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # an empty table has no ranges to read them from
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    counts = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range, so one task sees no more rows than there are ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")
    counts.select("_range", "_n", first).coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def indexed_page(spark: SparkSession, path: str, number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The rows of ``browse.page`` from the table written to ``path``."""
    check_page(number, size)
    start = (number - 1) * size
    ranges = spark.read.parquet(f"{path}/ranges")
    held = ranges.filter((F.col("_first") < start + size) & (F.col("_first") + F.col("_n") > start))
    first = {r["_range"]: r["_first"] for r in held.collect()}  # no more than the rows of a page
    shape = spark.read.parquet(f"{path}/columns").schema
    columns = list(shape.names)
    rows = spark.read.schema(shape.add("_place", "long").add("_range", "long")).parquet(f"{path}/rows")
    rows = rows.filter(F.col("_range").isin(list(first)))
    offset = F.lit(0)
    for range_, rows_before in first.items():
        offset = F.when(F.col("_range") == range_, rows_before).otherwise(offset)
    position = offset + F.col("_place")
    page = rows.withColumn("_position", position).filter(F.col("_position").between(start, start + size - 1))
    return page.orderBy("_position").select(*columns)
