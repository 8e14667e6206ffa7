"""Text helpers as Spark columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.numbers import fixed_text

# Characters that count as whitespace when text is trimmed.
_SPACE = r"[\s\x1c-\x1f]"

# Fixed values of the display rules.
PREVIEW_LENGTH = 240
MESSAGE_LENGTH = 2000
ELLIPSIS = "..."


def strip(col: Column) -> Column:
    """Trim every kind of whitespace at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(col, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, f"(?U){_SPACE}+$", "")


def blank_to_null(col: Column) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def search_pattern(term: str | None, *, escape: bool = False) -> str | None:
    """LIKE pattern for a user's search text; ``None`` means no filter.

    ``%`` and ``_`` stay wildcards unless ``escape`` is set. A backslash is an
    ordinary character in the search text but Spark's LIKE escape, so it doubles.
    """
    cleaned = (term or "").strip().lower()
    if not cleaned:
        return None
    cleaned = cleaned.replace("\\", "\\\\")
    if escape:
        cleaned = cleaned.replace("%", r"\%").replace("_", r"\_")
    return f"%{cleaned}%"


def matches_any(columns: list[Column], pattern: str) -> Column:
    """True when a lower-cased column matches; NULL columns never match."""
    hits = [F.coalesce(F.lower(c).like(pattern), F.lit(False)) for c in columns]
    return reduce(or_, hits)


def list_as_text(col: Column) -> Column:
    """A list of strings as JSON text with ``", "`` between items."""
    quoted = F.transform(
        col,
        lambda item: F.concat(
            F.lit('"'),
            F.replace(F.replace(item, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
            F.lit('"'),
        ),
    )
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def preview(col: Column, length: int = PREVIEW_LENGTH) -> Column:
    """Whole text up to ``length`` characters, else its right-trimmed head and an ellipsis."""
    head = rstrip(F.substring(col, 1, length))
    return F.when(F.length(col) <= length, col).otherwise(F.concat(head, F.lit(ELLIPSIS)))


def bounded_message(context: Column, kind: Column, details: Column) -> Column:
    """``context: kind[: details]``, cut to the stored message length."""
    cleaned = blank_to_null(details)
    message = F.concat(context, F.lit(": "), kind)
    message = F.when(cleaned.isNull(), message).otherwise(F.concat(message, F.lit(": "), cleaned))
    head = F.substring(message, 1, MESSAGE_LENGTH - len(ELLIPSIS))
    return F.when(F.length(message) <= MESSAGE_LENGTH, message).otherwise(
        F.concat(head, F.lit(ELLIPSIS))
    )


def export_file_name(name: Column, fallback: str) -> Column:
    """File-system safe name for a download."""
    dashed = F.regexp_replace(strip(name), r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^[-._]+|[-._]+$", ""), F.lit("")), F.lit(fallback))


def grader_key(name: Column) -> Column:
    """Column prefix of a grader in the wide export."""
    snake = F.regexp_replace(name, r"[^A-Za-z0-9]+", "_")
    core = F.lower(F.regexp_replace(snake, r"^_+|_+$", ""))
    return F.concat(F.lit("grader_"), F.coalesce(F.nullif(core, F.lit("")), F.lit("unknown")))


def format_name(name: Column) -> Column:
    """Response-format name with every unsupported character replaced."""
    return F.regexp_replace(name, r"[^a-zA-Z0-9_-]", "_")


def schema_name(description: Column) -> Column:
    """Snake-case name from the first three words; words with punctuation drop out."""
    words = F.slice(F.split(strip(description), rf"(?U){_SPACE}+"), 1, 3)
    kept = F.filter(words, lambda w: w.rlike(r"(?U)^[\p{L}\p{N}]+$"))
    return F.coalesce(
        F.nullif(F.array_join(F.transform(kept, F.lower), "_"), F.lit("")), F.lit("response")
    )


def strip_fences(reply: Column) -> Column:
    """Model reply without Markdown fence lines; untouched unless it opens with one."""
    text = strip(reply)
    lines = F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")
    kept = F.filter(lines, lambda line: ~F.startswith(strip(line), F.lit("```")))
    return F.when(F.startswith(text, F.lit("```")), strip(F.array_join(kept, "\n"))).otherwise(text)


def language_key(language: str) -> str:
    """Cache form of a target language (one driver-side value)."""
    return language.strip().casefold()


def cache_key(language: Column, text: Column) -> Column:
    """sha-256 of the language and the text with a NUL between them."""
    return F.sha2(F.concat(language, F.lit("\0"), text), 256)


# --- display text -----------------------------------------------------------


def percent_text(value: Column, *, ties: str = "even") -> Column:
    """A 0-1 value as a percentage with one decimal."""
    return F.concat(fixed_text(value * 100, 1, ties=ties), F.lit("%"))


def latency_text(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with two decimals."""
    whole = F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))
    return F.when(ms < 1000, whole).otherwise(
        F.concat(fixed_text(ms / 1000, 2, ties="up"), F.lit(" s"))
    )


def tokens_text(count: Column) -> Column:
    """Token counts with k and M suffixes."""
    return (
        F.when(count >= 1_000_000, F.concat(fixed_text(count / 1_000_000, 1, ties="up"), F.lit("M")))
        .when(count >= 1_000, F.concat(fixed_text(count / 1_000, 1, ties="up"), F.lit("k")))
        .otherwise(count.cast("string"))
    )


def magnitude_text(value: Column, decimals: int) -> Column:
    """Absolute value with fixed decimals, trailing zeros and dot removed."""
    fixed = fixed_text(F.abs(value), decimals)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
