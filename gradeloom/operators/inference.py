"""Batch inference and embeddings with an injected provider.

A provider is any picklable callable. It runs inside ``mapInPandas`` with a small
thread pool per task, so the number of calls in flight is (running tasks) x
(workers). Spark may run a task again: call ``cut_lineage`` on the result before
using it twice, so that no row is paid for or answered differently again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.json_text import quoted
from gradeloom.functions.text import format_name
from gradeloom.operators.joins import lookup_join
from gradeloom.session import cut_lineage

DEFAULT_WORKERS = 5

# Models that take no temperature.
REASONING_MODELS = (
    "o3", "o3-pro", "o3-mini", "o4-mini", "gpt-5.5", "gpt-5.5-pro", "gpt-5.4", "gpt-5.4-pro",
    "gpt-5.4-mini", "gpt-5.4-nano", "gpt-5.3-codex", "gpt-5.2", "gpt-5.2-pro", "gpt-5.1", "gpt-5",
    "gpt-5-pro", "gpt-5-mini", "gpt-5-nano",
)

REPLY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("latency_ms", T.IntegerType()),
        T.StructField("input_tokens", T.IntegerType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class Reply:
    """What a provider returns for one request."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None
    latency_ms: int | None = None


Provider = Callable[[dict], Reply]


def tool_specs(tools: Column, options: Column) -> Column:
    """Tool names as specs; ``options`` is a map with the optional ids."""
    store, container = options["vector_store_id"], options["container_id"]
    known = F.filter(tools, lambda t: t.isin("file_search", "code_interpreter", "shell"))
    environment = F.struct(
        F.when(container.isNotNull(), "container_reference").otherwise("container_auto").alias("type"),
        container.alias("container_id"),
    )
    return F.transform(
        known,
        lambda t: F.struct(
            t.alias("type"),
            F.when((t == "file_search") & store.isNotNull(), F.array(store)).alias("vector_store_ids"),
            F.when(t == "shell", environment).alias("environment"),
        ),
    )


def request_column(
    *,
    model: Column,
    system_prompt: Column,
    user_input: Column,
    temperature: Column | None = None,
    max_tokens: Column | None = None,
    tools: Column | None = None,
    tool_options: Column | None = None,
    reasoning_effort: Column | None = None,
    format_type: Column | None = None,
    format_label: Column | None = None,
    response_format: Column | None = None,
    reasoning: Column | None = None,
) -> Column:
    """One request as JSON text; keys without a value are left out.

    ``response_format`` and ``reasoning`` are JSON objects as text and go into the request
    as a whole, the format with a cleaned ``name``; ``format_type`` with ``format_label``
    and ``reasoning_effort`` are short forms of them. The same text is the input of an
    offline batch service.
    """
    none = F.lit(None).cast("string")
    effort = none if reasoning_effort is None else reasoning_effort
    whole = none if reasoning is None else reasoning
    thought = F.coalesce(
        F.try_variant_get(F.parse_json(whole), "$", "map<string,variant>"),
        F.when(effort.isNotNull(), F.create_map(F.lit("effort"), F.parse_json(quoted(effort)))),
    )
    heat = F.lit(0.7) if temperature is None else temperature
    options = F.create_map().cast("map<string,string>") if tool_options is None else tool_options
    messages = F.array(
        F.struct(F.lit("system").alias("role"), system_prompt.alias("content")),
        F.struct(F.lit("user").alias("role"), user_input.alias("content")),
    )
    reasons = model.isin(*REASONING_MODELS) | thought.isNotNull()
    parts = [
        model.alias("model"),
        messages.alias("input"),
        F.when(~reasons, heat).alias("temperature"),
        thought.alias("reasoning"),
    ]
    if max_tokens is not None:
        parts.append(max_tokens.alias("max_output_tokens"))
    if tools is not None:
        specs = tool_specs(tools, options)
        used = F.size(specs) > 0
        choice = options["tool_choice"]
        parts.append(F.when(used, specs).alias("tools"))
        parts.append(F.when(used & (choice != "auto") & (choice != ""), choice).alias("tool_choice"))
    if response_format is not None:
        fields = F.try_variant_get(F.parse_json(response_format), "$", "map<string,variant>")
        named = F.transform_values(
            fields,
            lambda k, v: F.when(
                k == "name", F.parse_json(quoted(format_name(F.try_variant_get(v, "$", "string"))))
            ).otherwise(v),
        )
        parts.append(F.when(fields.isNotNull(), F.struct(named.alias("format"))).alias("text"))
    elif format_type is not None:
        label = none if format_label is None else format_name(format_label)
        shape = F.struct(format_type.alias("type"), label.alias("name"))
        parts.append(F.when(format_type.isNotNull(), F.struct(shape.alias("format"))).alias("text"))
    return F.to_json(F.struct(*parts))


def reply_text(output: Column) -> Column:
    """Text of a landed response: every ``output_text`` part of every message, one per line.

    ``output`` is ``array<struct<type, content: array<struct<type, text>>>>``.
    """
    messages = F.filter(output, lambda item: item["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda item: F.coalesce(item["content"], F.array())))
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"])
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def _call(provider: Provider, request: str) -> tuple:
    start = time.perf_counter()
    try:
        reply = provider(json.loads(request))
    except Exception as exc:  # recorded on the row; the job goes on
        return None, None, None, None, str(exc)
    spent = reply.latency_ms
    if spent is None:
        spent = int((time.perf_counter() - start) * 1000)
    return reply.text, spent, reply.input_tokens, reply.output_tokens, None


def generate(
    df: DataFrame, provider: Provider, *, request: str = "request", out: str = "reply",
    workers: int = DEFAULT_WORKERS,
) -> DataFrame:
    """Add struct ``out`` (text, latency, tokens, error) with the provider's reply.

    A failing call becomes its row's ``error``; the other fields stay NULL.
    """

    fields = REPLY.fieldNames()

    @F.pandas_udf(REPLY)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for requests in batches:
                rows = list(pool.map(lambda r: _call(provider, r), requests))
                table = pd.DataFrame(rows, columns=fields)
                whole = {c: "Int32" for c in ("latency_ms", "input_tokens", "output_tokens")}
                yield table.astype(whole)

    # Non-deterministic, so the optimizer neither repeats nor moves the calls.
    return df.withColumn(out, ask.asNondeterministic()(F.col(request)))


def evaluate_rows(
    work: DataFrame, provider: Provider, *, system_prompt: Column, model: Column,
    user_input: str = "input", workers: int = DEFAULT_WORKERS, **request: Column,
) -> DataFrame:
    """Generate the output of every work row; adds output, latency, tokens and error."""
    built = request_column(
        model=model, system_prompt=system_prompt, user_input=F.col(user_input), **request
    )
    answered = generate(work.withColumn("_request", built), provider, request="_request", out="_reply", workers=workers)
    return answered.select(
        *work.columns,
        F.col("_reply.text").alias("actual_output"),
        F.col("_reply.latency_ms").alias("latency_ms"),
        F.col("_reply.input_tokens").alias("input_tokens"),
        F.col("_reply.output_tokens").alias("output_tokens"),
        F.col("_reply.error").alias("error"),
    )


Embedder = Callable[[list[str]], list[list[float]]]


def embed_texts(texts: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """``(text_key, vector)`` of each distinct text; one embedder call per Arrow batch.

    Keys are deduplicated before the call, so repeats cost nothing.
    """
    keyed = texts.select(F.sha2(F.col(column), 256).alias("text_key"), F.col(column).alias("text"))
    unique = keyed.filter(F.col("text").isNotNull()).groupBy("text_key").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder(batch["text"].tolist())
            yield pd.DataFrame({"text_key": batch["text_key"], "vector": vectors})

    return unique.mapInPandas(run, "text_key string, vector array<double>")


def embed_columns(
    df: DataFrame, columns: dict[str, str], embedder: Embedder, spread_by: list[str]
) -> DataFrame:
    """Add a vector column per text column; a text that fills most rows is spread.

    Vectors are written once before the joins read them, so each distinct text
    is embedded once. ``df`` is read twice: cut its lineage first when it holds
    fresh model replies.
    """
    texts = None
    for column in columns:
        part = df.select(F.col(column).alias("text"))
        texts = part if texts is None else texts.unionAll(part)
    vectors = cut_lineage(embed_texts(texts, "text", embedder))
    out = df
    for column, name in columns.items():
        side = vectors.select(F.col("text_key").alias("_key"), F.col("vector").alias(name))
        key = F.sha2(F.col(column), 256).alias("_key")
        out = lookup_join(
            out.select("*", key), side, ["_key"], spread_by=spread_by
        ).drop("_key")
    return out
