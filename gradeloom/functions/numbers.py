"""Rounding and number text with the exact semantics of binary doubles.

Spark's ``round``/``bround``/``format_number`` work on the shortest decimal form
of a double, so 0.35 counts as a tie although the stored value is below it. The
columns here decide on the exact binary value; all of it is double arithmetic
inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(value: Column, digits: int, *, ties: str = "even") -> Column:
    """Nearest double with ``digits`` decimals, decided without rounding error.

    With k = floor(|value| * 10**digits) the question is on which side of
    k + 1/2 the exact product lies. Splitting the value into two halves of the
    mantissa makes both partial products exact, so the sign of the sum is right.
    ``value`` appears often in the expression: pass a column, not a formula.
    """
    value = value.cast("double")
    size = F.abs(value)
    lower = F.floor(size * F.lit(float(10**digits)))
    doubled = F.lit(float(2 * 10**digits))
    spread = size * F.lit(134217729.0)  # 2**27 + 1 separates the mantissa halves
    high = spread - (spread - size)
    side = (high * doubled - (lower.cast("double") * 2.0 + 1.0)) + (size - high) * doubled
    # On an exact tie (side = 0) a tiny nudge decides: odd numbers go up, or all do.
    nudge = (lower % 2) * F.lit(1e-300) if ties == "even" else F.lit(1e-300)
    units = lower.cast("double") + (side + nudge > 0).cast("double")
    rounded = F.signum(value) * units / F.lit(float(10**digits))
    return F.when(size < 1e14, rounded).otherwise(value)


def fixed_text(value: Column, digits: int, *, ties: str = "even") -> Column:
    """Text with exactly ``digits`` (at least one) decimals."""
    text = F.format_string(f"%.{digits}f", exact_round(value, digits, ties=ties))
    return F.when(value.isNotNull(), text)


def float_text(value: Column) -> Column:
    """A double as shortest round-trip text: plain below 1e16, else ``1e+16`` style."""
    java = value.cast("double").cast("string")
    digits = F.regexp_replace(
        java.try_cast("decimal(38,21)").cast("string"), r"0+$", ""
    )
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).try_cast("int")
    science = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    size = F.abs(value.cast("double"))
    return (
        # Java writes the usual range, and zero, the same way.
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), java)
        .when(java.rlike("[NI]"), F.lower(F.replace(java, F.lit("inity"), F.lit(""))))
        .when((size >= 1e16) | (size < 1e-4), science)
        .otherwise(plain)
    )


def clamp01(value: Column) -> Column:
    """Limit a score to the range 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
