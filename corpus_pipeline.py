"""From raw documents to packed sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)``, where ``docs`` has the columns of
``documents``, and returns rows with the same columns; the last returns packed pieces.
Between two stages the rows are written and read again, so no stage repeats another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from gradeloom.llm.common import table
from gradeloom.llm.queries import public
from gradeloom.session import cut_lineage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; ``n_chars`` counts what is left."""
    kept = line_dedup.drop_lines(docs, min_chars=40, min_docs=5)
    n_chars = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8 or more)."""
    return ngram_join.keep_one(docs, width=5, threshold=(4, 5), by_row=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, public("word_bpe_49k.json"), size=4096)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard", distinct_documents),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Scores of a fitted model and tokens have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
