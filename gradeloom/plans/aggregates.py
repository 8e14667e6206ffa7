"""Queries over results and verdicts: summaries, statistics, order and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import browse, compare, merge, ordinals, summary
from gradeloom.plans import views
from gradeloom.plans.registry import query
from gradeloom.plans.views import SQL_RESULTS, SQL_VERDICTS, with_ctes

_ERR = "coalesce(error, '') <> ''"
_MEAN_LATENCY = "CAST(round_even(sum(coalesce(latency_ms, 0)) / greatest(count(*), 1), 0) AS BIGINT)"


def _mean(col: str) -> str:
    return f"coalesce(CAST(round_even(sum({col}) / count({col}), 0) AS BIGINT), 0)"


_SUMMARY = f"""
SELECT eval_run_id, count(*) AS total,
  count(*) FILTER (WHERE passed IS NOT NULL) AS judged,
  count(*) FILTER (WHERE passed) AS passed,
  count(*) FILTER (WHERE NOT passed) AS failed,
  count(*) FILTER (WHERE passed IS NULL AND NOT ({_ERR})) AS unjudged,
  count(*) FILTER (WHERE {_ERR}) AS errors,
  count(*) FILTER (WHERE passed)
    / greatest(count(*) FILTER (WHERE passed IS NOT NULL) + count(*) FILTER (WHERE {_ERR}), 1)::DOUBLE AS accuracy,
  coalesce(CAST(printf('%.4f', avg(score)) AS DOUBLE), 0) AS avg_score,
  {_MEAN_LATENCY} AS avg_latency_ms,
  {_mean("input_tokens")} AS avg_input_tokens,
  {_mean("output_tokens")} AS avg_output_tokens
FROM v_results GROUP BY eval_run_id"""


@query("d1_run_summary", with_ctes(_SUMMARY, SQL_RESULTS))
def d1(spark, sf):
    return summary.run_summary(views.results(spark, sf))


@query(
    "d1_summary_of_every_run",
    with_ctes(
        f"""SELECT r.id AS eval_run_id, coalesce(s.total, 0) AS total, coalesce(s.judged, 0) AS judged,
  coalesce(s.passed, 0) AS passed, coalesce(s.failed, 0) AS failed, coalesce(s.unjudged, 0) AS unjudged,
  coalesce(s.errors, 0) AS errors, coalesce(s.accuracy, 0.0::DOUBLE) AS accuracy,
  coalesce(s.avg_score, 0.0::DOUBLE) AS avg_score, coalesce(s.avg_latency_ms, 0) AS avg_latency_ms,
  coalesce(s.avg_input_tokens, 0) AS avg_input_tokens, coalesce(s.avg_output_tokens, 0) AS avg_output_tokens
FROM (SELECT o_orderkey AS id FROM orders) r LEFT JOIN ({_SUMMARY}) s ON s.eval_run_id = r.id""",
        SQL_RESULTS,
    ),
)
def d1_all(spark, sf):
    return summary.summary_for_runs(views.runs(spark, sf), views.results(spark, sf))


@query("d2_mean_latency", with_ctes(
    f"SELECT eval_run_id, {_MEAN_LATENCY} AS avg_latency_ms FROM v_results GROUP BY 1", SQL_RESULTS))
def d2(spark, sf):
    return views.results(spark, sf).groupBy("eval_run_id").agg(
        summary.mean_latency().alias("avg_latency_ms"))


@query("d3_mean_tokens", with_ctes(
    f"SELECT eval_run_id, {_mean('input_tokens')} AS avg_input_tokens,"
    f" {_mean('output_tokens')} AS avg_output_tokens FROM v_results GROUP BY 1", SQL_RESULTS))
def d3(spark, sf):
    return views.results(spark, sf).groupBy("eval_run_id").agg(
        summary.mean_tokens("input_tokens").alias("avg_input_tokens"),
        summary.mean_tokens("output_tokens").alias("avg_output_tokens"))


_STATS = """SELECT eval_run_id, grader, count(*) AS total,
  count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
  count(*) FILTER (WHERE passed IS NULL) AS unjudged, count(passed) AS judged,
  count(*) FILTER (WHERE passed) / greatest(count(passed), 1)::DOUBLE AS accuracy,
  coalesce(CAST(printf('%.4f', avg(score)) AS DOUBLE), 0) AS avg_score
FROM v_verdicts GROUP BY ALL"""


@query("d4_grader_stats", with_ctes(_STATS, SQL_VERDICTS))
def d4(spark, sf):
    return summary.grader_stats(
        summary.explode_details(views.results(spark, sf, details=True), ["eval_run_id"]))


@query("d4_grader_stats_map", with_ctes(
    f"""SELECT eval_run_id, count(*) AS graders,
  max(CASE WHEN grader = 'value' THEN avg_score END) AS value_avg_score,
  max(CASE WHEN grader = 'flaky' THEN failed END) AS flaky_failed
FROM ({_STATS}) GROUP BY 1""", SQL_VERDICTS))
def d4_map(spark, sf):
    stats = summary.stats_as_map(summary.grader_stats(views.verdicts(spark, sf)))
    return stats.select(
        "eval_run_id",
        F.size("grader_stats").cast("long").alias("graders"),
        F.col("grader_stats")["value"]["avg_score"].alias("value_avg_score"),
        F.col("grader_stats")["flaky"]["failed"].alias("flaky_failed"))


_VERDICT = """SELECT eval_run_id, row_id,
  coalesce(sum(CASE WHEN weight > 0 THEN weight * coalesce(score, 0) END)
           / sum(CASE WHEN weight > 0 THEN weight END), 0) AS score,
  coalesce(bool_and(CASE WHEN weight > 0 THEN passed END),
           CASE WHEN sum(CASE WHEN weight > 0 THEN weight END) > 0 THEN NULL ELSE false END) AS passed
FROM v_verdicts GROUP BY ALL"""


@query("d5_weighted_verdict", with_ctes(
    f"SELECT eval_run_id, row_id, round(score, 9) AS score, passed FROM ({_VERDICT})", SQL_VERDICTS))
def d5(spark, sf):
    verdict = summary.weighted_verdict(F.map_values("details"))
    return views.results(spark, sf, details=True).select(
        "eval_run_id", F.col("event_id").alias("row_id"), verdict.alias("v")
    ).select("eval_run_id", "row_id", F.round("v.score", 9).alias("score"), "v.passed")


@query("d5_weighted_verdict_long", with_ctes(
    f"SELECT eval_run_id, row_id, round(score, 9) AS score, passed FROM ({_VERDICT})", SQL_VERDICTS))
def d5_long(spark, sf):
    return summary.weighted_verdict_long(
        views.verdicts(spark, sf), ["eval_run_id", "row_id"]
    ).withColumn("score", F.round("score", 9))


@query("d6_page_counts", with_ctes(
    """SELECT eval_run_id, count(*) AS total, CAST(greatest(ceil(count(*) / 10.0), 1) AS BIGINT) AS pages
FROM v_results GROUP BY 1""", SQL_RESULTS))
def d6(spark, sf):
    return views.results(spark, sf).groupBy("eval_run_id").agg(
        F.count(F.lit(1)).alias("total")
    ).withColumn("pages", browse.page_counts(F.col("total"), F.lit(10)))


@query("d8_grader_names", with_ctes("SELECT DISTINCT grader FROM v_verdicts", SQL_VERDICTS))
def d8(spark, sf):
    return summary.distinct_graders(views.results(spark, sf, details=True))


@query("d9_first_weights", with_ctes(
    """SELECT eval_run_id, grader, arg_min(coalesce(weight, 1.0::DOUBLE), row_id) AS weight
FROM v_verdicts GROUP BY ALL""", SQL_VERDICTS))
def d9(spark, sf):
    return summary.first_weights(views.verdicts(spark, sf), ["eval_run_id"], F.col("row_id"))


@query("d12_unique_inputs", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def d12(spark, sf):
    return merge.first_seen(views.table(spark, sf, "documents"), "text", "doc_id")


@query("d13_progress_percent", with_ctes(
    """SELECT eval_run_id,
  CAST(floor(count(actual_output) / greatest(count(*), 1)::DOUBLE * 100 + 0.5) AS BIGINT) AS progress
FROM v_results GROUP BY 1""", SQL_RESULTS))
def d13(spark, sf):
    return views.results(spark, sf).groupBy("eval_run_id").agg(
        F.count("actual_output").alias("done"), F.count(F.lit(1)).alias("rows")
    ).select("eval_run_id", summary.progress_percent(F.col("done"), F.col("rows")).alias("progress"))


@query("b6_failed_only", with_ctes(
    "SELECT event_id, eval_run_id, row_index, score FROM v_results WHERE NOT passed", SQL_RESULTS))
def b6(spark, sf):
    return browse.failed_only(views.results(spark, sf, indexed=True)).select(
        "event_id", "eval_run_id", "row_index", "score")


@query("b11_result_status", with_ctes(
    f"""SELECT event_id, CASE WHEN {_ERR} THEN 'Error' WHEN passed THEN 'Pass' WHEN NOT passed THEN 'Fail'
  ELSE 'Score only' END AS status FROM v_results""", SQL_RESULTS))
def b11(spark, sf):
    return views.results(spark, sf).select(
        "event_id", browse.result_status(F.col("passed"), F.col("error")).alias("status"))


@query("e4_row_enumeration",
       "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def e4(spark, sf):
    return ordinals.number_sorted(views.table(spark, sf, "events").select("event_id"), [F.col("event_id")])


@query("e4_row_enumeration_per_run", with_ctes(
    "SELECT event_id, eval_run_id, row_index FROM v_results", SQL_RESULTS))
def e4_run(spark, sf):
    return views.results(spark, sf, indexed=True).select("event_id", "eval_run_id", "row_index")


@query("e5_batches", """
SELECT b AS batch, count(*) AS texts, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 50) AS BIGINT) AS b
      FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)) GROUP BY 1""")
def e5(spark, sf):
    unique = merge.first_seen(views.table(spark, sf, "documents"), "text", "doc_id").select("doc_id")
    placed = ordinals.number_sorted(unique, [F.col("doc_id")], "place")
    return placed.groupBy(F.floor(F.col("place") / 50).alias("batch")).agg(
        F.count(F.lit(1)).alias("texts"),
        F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"))


_WRITES = """
writes AS (SELECT user_id % 20 AS eval_run_id, event_id % 997 AS row_index, event_id AS arrival,
    'r' || event_id AS id, ts AS created_at, event_type AS actual_output, value AS score FROM events)"""


def _writes(spark, sf):
    return views.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("eval_run_id"),
        (F.col("event_id") % 997).alias("row_index"),
        F.col("event_id").alias("arrival"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("actual_output"),
        F.col("value").alias("score"))


@query("e6_last_write_wins", with_ctes(
    """SELECT eval_run_id, row_index, arg_min(id, arrival) AS id, arg_min(created_at, arrival) AS created_at,
  arg_max(actual_output, arrival) AS actual_output, arg_max(score, arrival) AS score
FROM writes GROUP BY ALL""", _WRITES))
def e6(spark, sf):
    return merge.last_write(
        _writes(spark, sf), ["eval_run_id", "row_index"], F.col("arrival"),
        ["actual_output", "score"], ["id", "created_at"])


@query("f5_grader_sort", with_ctes(
    """SELECT r.event_id, r.eval_run_id, CAST(CASE WHEN v.passed THEN 1 WHEN NOT v.passed THEN 0 ELSE 2 END AS INTEGER) AS rank
FROM v_results r JOIN v_verdicts v ON v.row_id = r.event_id AND v.grader = 'value'""",
    SQL_RESULTS, SQL_VERDICTS))
def f5(spark, sf):
    rows = views.results(spark, sf, details=True).withColumn("row_index", F.col("event_id"))
    return browse.sort_by_grader(rows, "value").select(
        "event_id", "eval_run_id",
        browse.grader_rank(F.col("details")["value"]["passed"]).alias("rank"))


@query("f6_results_in_order", with_ctes(
    "SELECT eval_run_id, row_index, event_id, actual_output FROM v_results ORDER BY 1, 2", SQL_RESULTS))
def f6(spark, sf):
    return views.results(spark, sf, indexed=True).select(
        "eval_run_id", "row_index", "event_id", "actual_output").orderBy("eval_run_id", "row_index")


def _sides(spark, sf, indexed=True):
    """Even runs against the odd run after them; unindexed rows use the event id, with gaps."""
    rows = views.results(spark, sf, indexed=indexed).withColumn(
        "pair_id", F.floor(F.col("eval_run_id") / 2))
    if not indexed:
        rows = rows.withColumn("row_index", F.col("event_id"))
    even = F.col("eval_run_id") % 2 == 0
    return rows.filter(even), rows.filter(~even)


def _compared(row_index: str) -> str:
    return f"""
sides AS (SELECT *, eval_run_id // 2 AS pair_id, eval_run_id % 2 AS side,
    row_number() OVER (PARTITION BY eval_run_id ORDER BY row_index) AS pos FROM v_results),
compared AS (
  SELECT a.pair_id, a.{row_index} AS row_index, a.input_data, a.expected_output, b.pos IS NOT NULL AS in_b,
    a.actual_output AS actual_output_a, b.actual_output AS actual_output_b, a.score AS score_a, b.score AS score_b,
    a.passed AS passed_a, b.passed AS passed_b, a.error AS error_a, b.error AS error_b,
    CASE WHEN a.score > b.score THEN 'A' WHEN b.score > a.score THEN 'B' WHEN a.score = b.score THEN 'Tie' END AS winner
  FROM (SELECT * FROM sides WHERE side = 0) a
  LEFT JOIN (SELECT * FROM sides WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos)"""


@query("c3_compare_runs", with_ctes("SELECT * FROM compared", SQL_RESULTS, _compared("event_id")))
def c3(spark, sf):
    return compare.compare_runs(*_sides(spark, sf, indexed=False), ["pair_id"], by_position=True)


@query("c3_compare_runs_by_row_index", with_ctes("SELECT * FROM compared", SQL_RESULTS, _compared("row_index")))
def c3_keyed(spark, sf):
    return compare.compare_runs(*_sides(spark, sf), ["pair_id"], by_position=False)


@query("c3a_winner_totals", with_ctes(
    """SELECT pair_id, count(*) FILTER (WHERE winner = 'A') AS a_wins, count(*) FILTER (WHERE winner = 'B') AS b_wins,
  count(*) FILTER (WHERE winner = 'Tie') AS ties, count(*) FILTER (WHERE winner IS NULL) AS undecided
FROM compared GROUP BY 1""", SQL_RESULTS, _compared("row_index")))
def c3a(spark, sf):
    compared = compare.compare_runs(*_sides(spark, sf), ["pair_id"], by_position=False)
    return compare.comparison_totals(compared, ["pair_id"])
