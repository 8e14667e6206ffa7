"""Paging rules as columns: start states, request values, next and previous pages.

Each function works on a table of sources (or landed pages), so thousands of
sources are planned in one job. Counters and sizes arrive as configured text;
values that are no integers fall back to the defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.joins import lookup_join

# Fixed values of the paging rules.
MODES = ("none", "page", "offset", "next_token")
OFFSET_PAGE_SIZE = 50
DEFAULT_NAMES = {"page": "page", "offset": "offset", "limit": "limit", "token": "page_token"}


def whole_number(text: Column, default: Column | int) -> Column:
    """Configured integer, or the default when the text is no integer."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    digits = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce(
        F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("long")), fallback.cast("long")
    )


def checked_mode(mode: Column) -> Column:
    """The mode itself; an unknown one stops the job."""
    message = F.concat(F.lit("Unsupported pagination mode: "), mode)
    return F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(message).cast("string"))


def start_position(mode: Column, config: Column, state: Column) -> Column:
    """Current page or offset: from the state, else from the configuration."""
    page = whole_number(state["page"], whole_number(config["start_page"], 1))
    offset = whole_number(state["offset"], whole_number(config["start_offset"], 0))
    mode = checked_mode(mode)
    return F.when(mode == "page", page).when(mode == "offset", offset)


def start_token(mode: Column, config: Column, state: Column) -> Column:
    """Current token: from the state when it has one (even NULL), else the initial one."""
    own = F.when(F.coalesce(F.map_contains_key(state, "token"), F.lit(False)), state["token"])
    first = F.when(
        ~F.coalesce(F.map_contains_key(state, "token"), F.lit(False)), config["initial_token"]
    )
    return F.when(mode == "next_token", F.coalesce(own, first))


def page_size(mode: Column, config: Column, override: Column) -> Column:
    """Requested size: override, configured, or 50 in offset mode (none in page mode)."""
    default = F.when(mode == "offset", F.lit(OFFSET_PAGE_SIZE))
    return F.coalesce(override.cast("long"), whole_number(config["page_size"], default))


def request_values(
    mode: Column, config: Column, position: Column, token: Column, size: Column
) -> Column:
    """``map<string,string>`` of the paging values one request carries."""

    def entry(name: Column, value: Column) -> Column:
        return F.struct(name.alias("key"), value.cast("string").alias("value"))

    def named(option: str, default: str) -> Column:
        return F.coalesce(config[option], F.lit(default))

    size_name = F.nullif(config["page_size_param"], F.lit(""))
    entries = F.array(
        F.when(mode == "page", entry(named("page_param", DEFAULT_NAMES["page"]), position)),
        F.when((mode == "page") & size.isNotNull() & size_name.isNotNull(), entry(size_name, size)),
        F.when(mode == "offset", entry(named("offset_param", DEFAULT_NAMES["offset"]), position)),
        F.when(mode == "offset", entry(named("limit_param", DEFAULT_NAMES["limit"]), size)),
        F.when(
            (mode == "next_token") & (F.coalesce(token, F.lit("")) != ""),
            entry(named("token_param", DEFAULT_NAMES["token"]), token),
        ),
    )
    return F.map_from_entries(F.array_compact(entries))


def placement(config: Column, body: Column) -> Column:
    """Where paging values go: the body only when asked for and an object exists."""
    in_body = (F.coalesce(config["placement"], F.lit("query")) == "body") & body.isNotNull()
    return F.when(in_body & body.startswith("{"), "body").otherwise("query")


def with_request(
    params: Column, body: Column, config: Column, values: Column
) -> tuple[Column, Column]:
    """Query parameters and body fields after the paging values are set."""
    where = placement(config, body)
    empty = F.create_map().cast("map<string,string>")
    fields = F.coalesce(F.from_json(body, "map<string,string>"), empty)

    def put(base: Column, extra: Column) -> Column:
        kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
        return F.map_concat(kept, extra)

    return (
        F.when(where == "query", put(params, values)).otherwise(params),
        F.when(where == "body", put(fields, values)).otherwise(F.when(body.isNotNull(), fields)),
    )


def has_more(flag: Column, records: Column, payload_has_items: Column) -> Column:
    """Whether another page follows: the response's own boolean, else whether this one had items."""
    return F.coalesce(flag, (records > 0) | payload_has_items)


def next_position(mode: Column, position: Column, size: Column, more: Column) -> Column:
    """Page + 1 or offset + size; NULL when there is no next page."""
    step = F.when(mode == "page", F.lit(1).cast("long")).when(mode == "offset", size)
    return F.when(more, position + step)


def next_token(token: Column) -> Column:
    """Token of the next page; an empty one ends the paging."""
    return F.nullif(token, F.lit(""))


def previous_position(mode: Column, position: Column, start: Column, size: Column) -> Column:
    """Page - 1, or the offset one size earlier but not before the start."""
    earlier = F.when(mode == "page", position - 1).when(
        mode == "offset", F.greatest(start, position - size)
    )
    return F.when(position > start, earlier)


def next_history(history: Column, token: Column) -> Column:
    """Tokens of the pages before the next one: the current page's is added."""
    return F.array_append(history, token)


def previous_token(history: Column) -> Column:
    """``struct(token, history)`` of the page before, popped from the history; NULL on the first page."""
    kept = F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0)))
    return F.when(F.size(history) > 0, F.struct(F.element_at(history, -1).alias("token"), kept.alias("history")))


def planned_pages(sources: DataFrame, first: str, step: str, pages: str) -> DataFrame:
    """One row per page of each source (``page_index``, ``position``)."""
    listed = sources.filter(F.col(pages) > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(pages).cast("long") - 1)).alias("page_index")
    )
    return listed.withColumn("position", F.col(first) + F.col("page_index") * F.col(step))


def cut_tail(pages: DataFrame, keys: list[str], more: Column) -> DataFrame:
    """Landed pages up to and including the first that says it is the last.

    Without ``keys`` all pages belong to one source.
    """
    if not keys:
        last = pages.filter(~more).agg(F.min("page_index").alias("_last"))  # one row
        kept = pages.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col("page_index") <= F.col("_last")))
        return kept.drop("_last")
    stops = pages.filter(~more).groupBy(*keys).agg(F.min("page_index").alias("_last"))
    return lookup_join(pages, stops, keys, "left", spread_by=["page_index"]).filter(
        F.col("_last").isNull() | (F.col("page_index") <= F.col("_last"))
    ).drop("_last")
