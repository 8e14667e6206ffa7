"""Upserts by key into a parquet table.

Each write lands in its own ``batch`` partition, replaced as a whole when the
same batch comes again, so a retried batch changes nothing. Reading resolves the
last write per key with one partially aggregated shuffle; nothing is rewritten
when a batch touches a run that owns most rows. ``compact`` folds old batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators.merge import last_write

@dataclass(frozen=True)
class KeyedTable:
    """A parquet folder with last-write-wins rows per key."""

    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    first: tuple[str, ...] = ()

    @property
    def payload(self) -> list[str]:
        return [f for f in self.schema.fieldNames() if f not in (*self.keys, *self.first)]

    def upsert(self, rows: DataFrame, batch: int, order: str | None = None) -> None:
        """Write one batch, numbered from 0; repeats of a key inside it resolve by ``order``."""
        if batch < 0:
            raise ValueError("batches are numbered from 0; -1 holds the compacted base")
        columns = self.schema.fieldNames()
        if order is not None:
            rows = last_write(rows, list(self.keys), F.col(order), self.payload, list(self.first))
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def writes(self, spark: SparkSession) -> DataFrame:
        """All writes with their ``batch`` number."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        return spark.read.schema(full).parquet(self.path)

    def current(self, spark: SparkSession) -> DataFrame:
        """One row per key: payload of the last batch, first columns of the earliest."""
        merged = last_write(
            self.writes(spark), list(self.keys), F.col("batch"), self.payload, list(self.first)
        )
        return merged.select(*self.schema.fieldNames())

    def compact(self, spark: SparkSession, target: str) -> KeyedTable:
        """Write the current rows as the base of a new folder and return that table.

        The base has a slot of its own below all batches, so a stream that starts anew
        with batch 0 adds to it and does not replace it.
        """
        self.current(spark).write.mode("errorifexists").parquet(f"{target}/batch=-1")
        return KeyedTable(target, self.schema, self.keys, self.first)


def results_table(path: str, schema: T.StructType) -> KeyedTable:
    """Results by run and row; the first write keeps ``id`` and ``created_at``."""
    return KeyedTable(path, schema, ("eval_run_id", "row_index"), ("id", "created_at"))


def translation_cache(path: str, schema: T.StructType) -> KeyedTable:
    """Translations by cache key; the first write keeps ``id`` and ``created_at``."""
    return KeyedTable(path, schema, ("cache_key",), ("id", "created_at"))
