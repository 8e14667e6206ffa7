"""Incremental import: follow a paged source and append its mapped records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def start_import(
    spark: SparkSession,
    source: str,
    options: dict[str, str],
    to_rows: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    *,
    interval: str = "1 second",
) -> StreamingQuery:
    """Append the rows of every new page to the parquet folder ``target``.

    ``to_rows`` turns landed pages into dataset rows. The paging position is the
    stream's offset: after a restart the import goes on with the next page, and
    the batch's own folder makes a replayed batch harmless.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        to_rows(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    pages = spark.readStream.format(source).options(**options).load()
    return (
        pages.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )
