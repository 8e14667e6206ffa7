from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.operators import browse, compare, maintenance, summary, trends

RESULT = (
    "eval_run_id string, row_index int, score double, passed boolean, error string, latency_ms int, "
    "input_tokens int, output_tokens int"
)


def summarise(spark, rows):
    df = spark.createDataFrame([("r", i, *row) for i, row in enumerate(rows)], RESULT)
    return summary.run_summary(df).first().asDict()


def test_summary_counts_null_verdicts_apart(spark):
    got = summarise(spark, [
        (1.0, True, None, 100, 10, 4), (0.0, False, None, 200, 20, 5), (0.5, None, None, 301, None, 6),
        (None, None, "boom", None, None, None),
    ])
    assert got == {
        "eval_run_id": "r", "total": 4, "judged": 2, "passed": 1, "failed": 1, "unjudged": 1, "errors": 1,
        "accuracy": 1 / 3, "avg_score": 0.5, "avg_latency_ms": 150, "avg_input_tokens": 15, "avg_output_tokens": 5,
    }


def test_missing_latency_stays_in_the_denominator(spark):
    got = summarise(spark, [(None, None, "x", None, None, None), (1.0, True, "", 5, None, None)])
    assert got["avg_latency_ms"] == 2  # 2.5 goes to the even neighbour
    assert got["avg_input_tokens"] == 0
    assert got["errors"] == 1  # empty error text is no error


def test_run_without_results_has_a_zero_summary(spark):
    runs = spark.createDataFrame([("a",), ("r",)], "id string")
    results = spark.createDataFrame([("r", 0, 1.0, True, None, 10, 1, 1)], RESULT)
    got = {r["eval_run_id"]: r for r in summary.summary_for_runs(runs, results).collect()}
    assert got["a"]["total"] == 0 and got["a"]["accuracy"] == 0.0 and got["r"]["accuracy"] == 1.0


def test_grader_stats_failures_without_score(spark):
    rows = [("r", "g", 1.0, True, 1.0), ("r", "g", None, False, 1.0), ("r", "g", 0.25, None, 1.0)]
    df = spark.createDataFrame(rows, "eval_run_id string, grader string, score double, passed boolean, weight double")
    got = summary.grader_stats(df).first()
    assert (got["total"], got["passed"], got["failed"], got["unjudged"], got["judged"]) == (3, 1, 1, 1, 2)
    assert (got["accuracy"], got["avg_score"]) == (0.5, 0.625)


VERDICTS = "array<struct<score:double,passed:boolean,weight:double>>"


def combine(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], f"v {VERDICTS}")
    return [tuple(r[0]) for r in df.select(summary.weighted_verdict(F.col("v"))).collect()]


def test_weighted_verdict_rules(spark):
    assert combine(spark, [
        [(1.0, True, 0.5), (0.8, True, 1.0)],
        [(1.0, True, 1.0), (0.0, False, 0.0)],
        [(1.0, True, 0.0), (1.0, True, 0.0)],
        [(0.4, None, 1.0)],
        [(1.0, True, 1.0), (None, False, 1.0)],
        [],
    ]) == [((0.5 + 0.8) / 1.5, True), (1.0, True), (0.0, False), (0.4, None), (0.5, False), (0.0, False)]


verdict = st.tuples(
    st.one_of(st.none(), st.integers(0, 8).map(lambda n: n / 8)), st.one_of(st.none(), st.booleans()),
    st.sampled_from([0.0, 0.25, 0.5, 1.0]))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(verdict, max_size=5), min_size=5, max_size=20))
def test_weight_zero_and_scaling_never_matter(spark, rows):
    base = combine(spark, rows)
    assert combine(spark, [[*r, (0.5, False, 0.0)] for r in rows]) == base
    assert combine(spark, [[(s, p, w * 2) for s, p, w in r] for r in rows]) == base


def test_long_form_gives_the_same_verdict(spark):
    rows = [("r", 0, "a", 0.5, True, 1.0), ("r", 0, "b", None, False, 0.5), ("r", 1, "a", 0.2, None, 0.0)]
    df = spark.createDataFrame(rows, "run string, row int, grader string, score double, passed boolean, weight double")
    got = {r["row"]: (r["score"], r["passed"]) for r in summary.weighted_verdict_long(df, ["run", "row"]).collect()}
    assert got == {0: (0.5 / 1.5, False), 1: (0.0, False)}


# --- browse ---------------------------------------------------------------------


def configs(spark):
    rows = [
        (i, f"Config {i}", "Alpha team" if i % 2 else None, "Prompt", "model-a", ["prod" if i < 3 else "draft", "Q"],
         dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3))
        for i in range(13)
    ]
    return spark.createDataFrame(
        rows, "id long, name string, comment string, system_prompt string, model string, tags array<string>, created_at timestamp_ntz")


def test_search_and_tags_combine_and_page(spark):
    df = configs(spark)
    assert browse.search_configs(df, " ALPHA ").count() == 6
    assert browse.search_configs(df, "alpha", ["prod"]).count() == 1
    assert browse.search_configs(df, None, ["pro"]).count() == 3
    assert browse.search_configs(df, None, ["pro"], whole_tags=True).count() == 0
    assert browse.search_configs(df, "", []).count() == 13
    second = [r["id"] for r in browse.page(df, 2, 5).collect()]
    assert second == [7, 6, 5, 4, 3]


def test_deep_and_near_pages_agree(spark):
    df = spark.range(10_400).select(
        "id", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 5000 * 60)).cast("timestamp_ntz").alias("created_at"))
    want = [r["id"] for r in browse.newest_first(df).collect()]
    assert [r["id"] for r in browse.page(df, 104, 100).collect()] == want[10_300:10_400]
    assert [r["id"] for r in browse.page(df, 3, 100).collect()] == want[200:300]


@pytest.mark.parametrize("number, size", [(0, 10), (1, 0), (1, 101)])
def test_page_limits(spark, number, size):
    with pytest.raises(ValueError):
        browse.page(configs(spark), number, size)


def test_stale_runs_fail_once(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [
        ("old", "running", now - dt.timedelta(minutes=60), now), ("fresh", "running", now - dt.timedelta(minutes=5), now),
        ("edge", "running", now - dt.timedelta(minutes=30), now), ("none", "pending", None, now - dt.timedelta(hours=2)),
        ("done", "completed", now - dt.timedelta(hours=5), now),
    ]
    df = spark.createDataFrame(rows, "id string, status string, heartbeat_at timestamp_ntz, created_at timestamp_ntz").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("error_message"))
    once = browse.fail_stale(df, F.lit(now).cast("timestamp_ntz"))
    got = {r["id"]: r for r in once.collect()}
    assert {k for k, r in got.items() if r["status"] == "failed"} == {"old", "none"}
    assert got["old"]["heartbeat_at"] == now and got["old"]["error_message"] == browse.STALE_MESSAGE
    assert sorted(browse.fail_stale(once, F.lit(now).cast("timestamp_ntz")).collect()) == sorted(once.collect())


def test_result_status(spark):
    rows = [(True, "x"), (True, ""), (False, None), (None, None)]
    df = spark.createDataFrame(rows, "p boolean, e string")
    got = [r[0] for r in df.select(browse.result_status(F.col("p"), F.col("e"))).collect()]
    assert got == ["Error", "Pass", "Fail", "Score only"]


def test_sort_by_grader_keeps_order_within_ranks(spark):
    kind = "map<string,struct<score:double,passed:boolean>>"
    rows = [("r", 0, {"g": (1.0, True)}), ("r", 1, {"g": (0.0, False)}), ("r", 2, {}), ("r", 3, {"g": (0.4, None)}), ("r", 4, {"g": (0.0, False)})]
    df = spark.createDataFrame(rows, f"eval_run_id string, row_index int, details {kind}")
    assert [r["row_index"] for r in browse.sort_by_grader(df, "g").collect()] == [1, 4, 0, 2, 3]
    assert [r["row_index"] for r in browse.sort_by_grader(df, "g", pass_first=True).collect()] == [0, 1, 4, 2, 3]


def test_audits(spark):
    kind = "array<struct<name:string,type:string,weight:double,schema:string>>"
    rows = [([],), ([("a", None, None, None)],), ([("a", "llm", 2.0, None), ("a", "json_schema", 1.0, None)],)]
    df = spark.createDataFrame(rows, f"g {kind}")
    got = [r[0] for r in df.select(browse.grader_violations(F.col("g"))).collect()]
    assert got == [["no_graders"], [], ["duplicate_names", "weight_out_of_range", "unknown_type", "schema_missing"]]
    maps = spark.createDataFrame([({"input": "a", "expected_output": "b"},), ({"input": ""},), ({"": "x"},)], "m map<string,string>")
    assert [r[0] for r in maps.select(browse.mapping_violations(F.col("m"))).collect()] == [
        [], ["missing_expected_output", "empty_value"], ["missing_input", "missing_expected_output", "empty_key"]]


# --- trends, comparison, maintenance ------------------------------------------------


def test_trend_text(spark):
    rows = [(0.9, 0.81, 800.0, (0.7, 0.8104, 1200.0)), (0.7, 0.5, 1000.0, None), (0.5, 0.5, 10.0, (0.5, 0.7, 8.0))]
    df = spark.createDataFrame(rows, "accuracy double, avg_score double, avg_latency_ms double, previous struct<accuracy:double,avg_score:double,avg_latency_ms:double>")
    got = [tuple(r) for r in trends.trend(df).select("accuracy_text", "score_text", "latency_text").collect()]
    assert got == [
        ("90.0% 🟢 ▲ +20pp", "0.810 •", "800 ms 🟢 ▼ -400ms"),
        ("70.0%", "0.500", "1000 ms"),
        ("50.0% •", "0.500 🔴 ▼ -0.2", "10 ms 🔴 ▲ +2ms"),
    ]


def test_winner_needs_both_scores(spark):
    df = spark.createDataFrame([(1.0, 0.5), (0.1, 0.2), (0.3, 0.3), (None, 0.1), (0.1, None)], "a double, b double")
    assert [r[0] for r in df.select(compare.winner(F.col("a"), F.col("b"))).collect()] == ["A", "B", "Tie", None, None]


def test_comparison_pairs_by_position(spark):
    def side(rows):
        return spark.createDataFrame(
            [("p", i, "in", "ex", o, s, None, None) for i, o, s in rows],
            "pair string, row_index long, input_data string, expected_output string, actual_output string, score double, passed boolean, error string")

    a, b = side([(0, "a0", 1.0), (5, "a5", 0.2), (9, "a9", 0.1)]), side([(0, "b0", 0.5), (1, "b1", 0.9)])
    got = compare.compare_runs(a, b, ["pair"]).orderBy("row_index").collect()
    assert [(r["actual_output_a"], r["actual_output_b"], r["winner"]) for r in got] == [
        ("a0", "b0", "A"), ("a5", "b1", "B"), ("a9", None, None)]
    keyed = compare.compare_runs(a, b, ["pair"], by_position=False).orderBy("row_index").collect()
    assert [r["in_b"] for r in keyed] == [True, False, False]


def test_unified_graders(spark):
    df = spark.createDataFrame(
        [("json_field_match, exact_match", {"json_field_match": 0.5, "custom:tone": 0.2}, [("tone", "Rate", 0.6, None)]), (None, None, None)],
        "t string, w map<string,double>, c array<struct<name:string,prompt:string,threshold:double,weight:double>>")
    got = [r[0] for r in df.select(maintenance.unify_graders(F.col("t"), F.col("w"), F.col("c"))).collect()]
    assert [tuple(g) for g in got[0]] == [
        ("json_field_match", "json_field", None, 0.7, 0.5), ("tone", "prompt", "Rate", 0.6, 0.2)]
    assert got[1] == []


def test_duplicates_point_at_their_copies(spark):
    parents = spark.createDataFrame([("s1", "Source", True)], "id string, name string, readonly boolean")
    children = spark.createDataFrame([("c1", "s1"), ("c2", "s9")], "id string, source_id string")
    def new_id(c):
        return F.concat(F.lit("n-"), F.col(c))

    copy = maintenance.duplicate_parents(parents, new_id("id"), readonly=F.lit(False)).first()
    assert (copy["id"], copy["name"], copy["readonly"]) == ("n-s1", "Source copy", False)
    kids = maintenance.duplicate_children(children, parents, "source_id", new_id("id"), new_id("id")).collect()
    assert [(k["id"], k["source_id"]) for k in kids] == [("n-c1", "n-s1")]
