from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import numbers, text
from gradeloom.functions.json_text import canonical_json, datetime_text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def apply(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_exact_round_and_fixed_text_agree_with_python(spark):
    rng = random.Random(7)
    values = [round(rng.random() * 10 ** rng.randint(0, 6), rng.randint(1, 5)) for _ in range(4000)]
    values += [k / 16 for k in range(200)] + [-k / 32 for k in range(100)] + [0.00015, 0.12345, 2.5]
    df = column(spark, values, "double")
    for digits in (1, 2, 3, 4):
        rounded = apply(df, numbers.exact_round(F.col("x"), digits))
        assert rounded == [round(v, digits) for v in values]
        assert apply(df, numbers.fixed_text(F.col("x"), digits)) == [f"{v:.{digits}f}" for v in values]


def test_ties_can_go_up(spark):
    df = column(spark, [0.25, 1.25, 0.35, 0.75], "double")
    assert apply(df, numbers.fixed_text(F.col("x"), 1, ties="up")) == ["0.3", "1.3", "0.3", "0.8"]


def test_float_text_is_shortest_round_trip_text(spark):
    values = [1.0, 0.1, 12345678.9, 1e16, 1.5e-5, 1e22, 1e-4, -2.5, 0.0, -0.0, 1.7976931348623157e308, 5e15]
    values += [float("inf"), float("-inf")]
    df = column(spark, values, "double")
    assert apply(df, numbers.float_text(F.col("x"))) == [repr(v) for v in values]


def test_null_numbers_stay_null(spark):
    df = column(spark, [None], "double")
    assert apply(df, numbers.fixed_text(F.col("x"), 2)) == [None]
    assert apply(df, numbers.exact_round(F.col("x"), 2)) == [None]


def test_strip_covers_all_whitespace(spark):
    values = ["  a b\t\n", " x\x1f", "", "  "]
    df = column(spark, values)
    assert apply(df, text.strip(F.col("x"))) == [v.strip() for v in values]


@pytest.mark.parametrize("term, pattern", [(None, None), ("  ", None), (" AbC ", "%abc%"), ("a_b%", "%a_b%%")])
def test_search_pattern(term, pattern):
    assert text.search_pattern(term) == pattern


def test_search_pattern_can_escape_wildcards(spark):
    df = column(spark, ["a_b", "axb", "a\\b", None])
    def hits(pattern):
        return apply(df, text.matches_any([F.col("x")], pattern))

    assert hits(text.search_pattern("a_b")) == [True, True, True, False]
    assert hits(text.search_pattern("a_b", escape=True)) == [True, False, False, False]
    assert hits(text.search_pattern("a\\b")) == [False, False, True, False]


def test_preview_and_messages(spark):
    df = column(spark, ["x" * 240, "y" * 235 + "     " + "tail", "z" * 241])
    got = apply(df, text.preview(F.col("x")))
    assert got == ["x" * 240, "y" * 235 + "...", "z" * 240 + "..."]
    long = apply(column(spark, ["d" * 3000]), text.bounded_message(F.lit("Run failed"), F.lit("ValueError"), F.col("x")))
    assert len(long[0]) == 2000 and long[0].endswith("...") and long[0].startswith("Run failed: ValueError: d")


def test_names(spark):
    df = column(spark, [" My set (v2)! ", "...", "custom:clarity", "llm_judge", "##"])
    assert apply(df, text.export_file_name(F.col("x"), "dataset"))[:2] == ["My-set-v2", "dataset"]
    assert apply(df, text.grader_key(F.col("x")))[2:] == [
        "grader_custom_clarity", "grader_llm_judge", "grader_unknown"]
    described = column(spark, ["A user's profile card", "Größe und Gewicht", "!!! ???"])
    assert apply(described, text.schema_name(F.col("x"))) == ["a_profile", "größe_und_gewicht", "response"]


def test_fences(spark):
    df = column(spark, ['```json\n{"a": 1}\n```', '  {"a": 1} ', "text ```\nx```"])
    assert apply(df, text.strip_fences(F.col("x"))) == ['{"a": 1}', '{"a": 1}', "text ```\nx```"]


def test_display_text(spark):
    df = column(spark, [999, 1500, 2_345_678], "long")
    assert apply(df, text.tokens_text(F.col("x"))) == ["999", "1.5k", "2.3M"]
    assert apply(df, text.latency_text(F.col("x"))) == ["999 ms", "1.50 s", "2345.68 s"]
    shares = column(spark, [0.0, 0.123, 1.0], "double")
    assert apply(shares, text.percent_text(F.col("x"))) == ["0.0%", "12.3%", "100.0%"]
    assert apply(column(spark, [2.10, -3.0, 0.04], "double"), text.magnitude_text(F.col("x"), 1)) == ["2.1", "3", "0"]


def test_language_key_folds_case():
    assert text.language_key("  Weißrussisch ") == "weissrussisch"


def test_canonical_json_sorts_and_spaces(spark):
    df = spark.createDataFrame(
        [(({"b": 1.0, "a": None}, ("ü\"", True, None)),)],
        "x struct<m: map<string,double>, s: struct<z: string, a: boolean, gone: string>>",
    )
    made = apply(df, canonical_json(F.col("x"), df.schema["x"].dataType))
    assert made == ['{"m": {"a": null, "b": 1.0}, "s": {"a": true, "z": "ü\\""}}']


def test_datetime_text_keeps_six_digits(spark):
    df = column(spark, ["2024-01-02 03:04:05.100000", "2024-01-02 03:04:05"])
    made = apply(df, datetime_text(F.col("x").cast("timestamp_ntz")))
    assert made == ["2024-01-02 03:04:05.100000", "2024-01-02 03:04:05"]
