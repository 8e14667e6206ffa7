"""Translation of text columns: dedupe, cache, batch, apply."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import cache_key, language_key
from gradeloom.operators.joins import lookup_join
from gradeloom.session import cut_lineage

# Fixed values of the translation request.
BATCH_SIZE = 50
INSTRUCTION = """
Translate each input string into the requested language.
Preserve row order, line breaks, markdown, URLs, code blocks, placeholders, and empty strings.
Return only JSON that matches the schema.
""".strip()

# (instruction, JSON request) -> JSON reply
Translator = Callable[[str, str], str]
FRESH = "cache_key string, source_text string, translated_text string"


def unique_texts(df: DataFrame, fields: list[str], language: str) -> DataFrame:
    """Distinct texts of the fields with their cache key.

    Grouping by key and text combines before the shuffle, so a text that fills
    most rows costs one row per input partition.
    """
    texts = df.select(F.explode(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])).alias("source_text"))
    key = cache_key(F.lit(language_key(language)), F.col("source_text"))
    return texts.groupBy("source_text").agg(F.count(F.lit(1)).alias("uses")).select(
        key.alias("cache_key"), "source_text", "uses"
    )


def cached(unique: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts the cache knows; the text itself must agree, not only its hash."""
    known = cache.select("cache_key", "source_text", "translated_text")
    return unique.select("cache_key", "source_text").join(known, ["cache_key", "source_text"])


def missing(unique: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Texts that need a translation; empty text never does."""
    wanted = unique.select("cache_key", "source_text").filter(F.col("source_text") != "")
    if cache is None:
        return wanted
    known = cache.select("cache_key", "source_text")
    return wanted.join(known, ["cache_key", "source_text"], "left_anti")


def looked_up(unique: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cached`` and ``missing`` from one join, which is written once."""
    known = cache.select("cache_key", "source_text", "translated_text", F.lit(True).alias("_known"))
    texts = unique.select("cache_key", "source_text")
    found = cut_lineage(texts.join(known, ["cache_key", "source_text"], "left"))
    hits = found.filter("_known").drop("_known")
    return hits, found.filter("_known IS NULL AND source_text <> ''").select("cache_key", "source_text")


def parse_reply(reply: Column, expected: Column) -> Column:
    """Translations of a reply, or NULL when it has another shape or length."""
    doc = F.try_parse_json(reply)
    items = F.try_variant_get(doc, "$.translations", "array<variant>")
    texts = F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
    fits = (F.size(texts) == expected) & ~F.exists(texts, lambda t: t.isNull())
    return F.when(fits, texts)


def read_reply(reply: str, count: int) -> list[str]:
    """The same for one reply inside a task; raises ``ValueError`` on a mismatch."""
    found = json.loads(reply)
    texts = found.get("translations") if isinstance(found, dict) else None
    if not isinstance(texts, list) or len(texts) != count or not all(isinstance(t, str) for t in texts):
        raise ValueError(f"Translation response must be a list of {count} strings")
    return texts


def request_translations(misses: DataFrame, language: str, translator: Translator) -> DataFrame:
    """Translate in batches of fifty; a malformed reply is retried text by text.

    A single text that still fails stops the job.
    """

    def ask(texts: list[str]) -> list[str]:
        request = json.dumps({"target_language": language, "inputs": texts}, ensure_ascii=False)
        return read_reply(translator(INSTRUCTION, request), len(texts))

    def ask_safely(texts: list[str]) -> list[str]:
        try:
            return ask(texts)
        except ValueError:
            if len(texts) == 1:
                raise
            return [ask([text])[0] for text in texts]

    def answer(block: pd.DataFrame) -> pd.DataFrame:
        return block.assign(translated_text=ask_safely(block["source_text"].tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            full = len(waiting) // BATCH_SIZE * BATCH_SIZE
            for start in range(0, full, BATCH_SIZE):
                yield answer(waiting.iloc[start : start + BATCH_SIZE])
            waiting = waiting.iloc[full:].reset_index(drop=True)
        if waiting is not None and len(waiting):
            yield answer(waiting)

    return misses.select("cache_key", "source_text").mapInPandas(run, FRESH)


def apply_translations(
    df: DataFrame, fields: list[str], known: DataFrame, language: str, spread_by: list[str]
) -> DataFrame:
    """Replace each field by its translation.

    Rows join by hash key, without the text that is replaced; a text shared by most rows is
    spread over many tasks.
    """
    out = df
    order = df.columns
    for name in fields:
        text = F.coalesce(F.col(name), F.lit(""))
        key = cache_key(F.lit(language_key(language)), text).alias("cache_key")
        side = known.select("cache_key", F.col("translated_text").alias("_translated"))
        rest = [F.col(c) for c in out.columns if c != name]
        out = lookup_join(
            out.select(*rest, (text == "").alias("_empty"), key), side, ["cache_key"], "left",
            spread_by=spread_by,
        )
        out = out.withColumn(
            name, F.when(F.col("_empty"), F.lit("")).otherwise(F.col("_translated"))
        ).drop("_translated", "_empty", "cache_key")
    return out.select(*order)


def translate_columns(
    df: DataFrame,
    fields: list[str],
    language: str,
    translator: Translator,
    *,
    spread_by: list[str],
    cache: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Translated rows and the fresh translations (to be upserted into the cache).

    The fresh translations are written once before they are used twice, so a
    lost executor never makes the translator answer again, or differently.
    """
    names = [f.strip() for f in fields if f.strip()]
    if not names:
        raise ValueError("Translation fields must not be empty")
    if not language.strip():
        raise ValueError("Target language is required")
    if lacking := sorted(n for n in names if n not in df.columns):
        raise ValueError(f"Mapped rows must include {', '.join(lacking)}")
    unique = unique_texts(df, names, language)
    hits, misses = (None, missing(unique, None)) if cache is None else looked_up(unique, cache)
    fresh = cut_lineage(request_translations(misses, language.strip(), translator))
    known = fresh if hits is None else hits.unionByName(fresh)
    return apply_translations(df, names, known, language, spread_by), fresh


def cache_rows(fresh: DataFrame, language: str, now: Column) -> DataFrame:
    """Fresh translations as rows of the cache table."""
    return fresh.select(
        "cache_key",
        F.col("cache_key").alias("id"),
        now.alias("created_at"),
        F.lit(language_key(language)).alias("target_language"),
        "source_text",
        "translated_text",
        now.alias("updated_at"),
    )
