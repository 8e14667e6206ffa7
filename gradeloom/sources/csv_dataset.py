"""CSV datasets: read, check, profile, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources.records import REQUIRED_COLUMNS

PREVIEW_ROWS = 5

# Quotes double inside quoted cells; cells may hold line breaks; a quoted empty
# cell is empty text, and short rows end in NULL until they are filled.
READ_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\u0000",
    "emptyValue": "", "inferSchema": "false", "enforceSchema": "false", "mode": "PERMISSIVE",
    "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_dataset(spark: SparkSession, path: str, *, line_breaks: bool = True) -> DataFrame:
    """Dataset rows as text columns named by the header; missing cells are empty.

    A cell with a line break forces one task per file. Files that are known to
    have none can be split: pass ``line_breaks=False``.
    """
    options = {**READ_OPTIONS, "multiLine": str(line_breaks).lower()}
    return spark.read.options(**options).csv(path).fillna("")


def check_dataset(df: DataFrame) -> DataFrame:
    """The frame itself when it has the required columns (decided without reading rows)."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"Dataset missing required columns: {', '.join(missing)}")
    return df


def profile(df: DataFrame, order: str) -> DataFrame:
    """One row: row count, column list and the first five rows.

    The preview is a top-k; only its five rows and the count meet.
    """
    place = F.struct(F.col(order).alias("at"), F.struct(*df.columns).alias("row"))
    first = df.orderBy(order).limit(PREVIEW_ROWS).agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda p: p["row"]).alias("preview")
    )
    shape = first.schema["preview"].dataType
    count = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("preview", F.lit(None).cast(shape))
    both = count.unionByName(first.withColumn("row_count", F.lit(None).cast("long")))
    names = F.array(*[F.lit(c) for c in df.columns]).alias("columns")
    return both.agg(
        F.max("row_count").alias("row_count"), F.any_value("preview", True).alias("preview")
    ).select("row_count", names, "preview")


def write_dataset(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write rows as CSV in the declared column order; absent or NULL cells are empty.

    Replaces the target. Never write to the folder ``df`` is read from.
    """
    present = set(df.columns)
    cells = [
        (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in present else F.lit("")).alias(c)
        for c in columns
    ]
    df.select(*cells).write.mode("overwrite").options(
        header="true", quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)


def overwrite_rows(df: DataFrame, path: str, columns: list[str]) -> int:
    """Replace all rows of a dataset and return the new row count."""
    if any(c not in columns for c in REQUIRED_COLUMNS):
        raise ValueError("Dataset missing required columns")
    write_dataset(df, path, columns)
    return read_dataset(df.sparkSession, path).count()
