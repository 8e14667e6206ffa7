"""Columns shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stands for a null id inside an operator: sorts first and equals itself.
NULL_ID = -(2**63)

# The white space of the text contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def document_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns ``doc`` (long, nulls as NULL_ID) and ``body`` (text, nulls as empty)."""
    return [
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"),
    ]


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(*document_columns(id_col, text_col))


def outer_id(name: str = "doc") -> Column:
    """Turn an internal id back into the id of the caller."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def key128(text: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: columns ``h1`` and ``h2``."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def row_key() -> Column:
    """Key of a row: the hash of id and text. Equal rows have the same key."""
    return F.xxhash64("doc", "body").alias("key")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
