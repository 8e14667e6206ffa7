"""Entity views over the given tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.ordinals import with_neighbour, with_ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def results(spark: SparkSession, sf_dir: str, *, indexed: bool = False, details: bool = False) -> DataFrame:
    """Events as evaluation results; 20 runs."""
    df = shape_results(table(spark, sf_dir, "events"), details=details)
    return with_ordinal(df, ["eval_run_id"], "event_id", "row_index") if indexed else df


def shape_results(events: DataFrame, *, details: bool = False) -> DataFrame:
    """The result columns of (batch or streaming) events."""
    events = events.withColumn("k", _k())
    ok = F.col("event_type") != "error"
    columns = [
        F.col("event_id"),
        (F.col("user_id") % 20).alias("eval_run_id"),
        F.col("event_type").alias("input_data"),
        F.when(F.col("value") >= 50, "purchase").otherwise("view").alias("expected_output"),
        F.when(ok, F.col("event_type")).alias("actual_output"),
        F.when(~ok, "API error").alias("error"),
        F.when(ok, F.least(F.col("value") / 100, F.lit(1.0))).alias("score"),
        F.when(ok & (F.col("event_type") != "signup"), F.col("value") >= 30).alias("passed"),
        F.when(ok, F.col("k") * 10).alias("latency_ms"),
        F.when(ok & (F.col("k") % 7 != 0), F.col("k") + 1).alias("input_tokens"),
        F.when(ok, F.floor("value").cast("int")).alias("output_tokens"),
        F.col("ts").alias("created_at"),
    ]
    if details:
        columns.append(F.map_from_entries(_verdict_entries()).alias("details"))
    return events.select(*columns)


def _verdict_entries() -> Column:
    k, kind = F.col("k"), F.col("event_type")
    broken = k % 11 == 0

    def entry(name: str, weight: Column, score: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("grader"),
            F.struct(
                score.cast("double").alias("score"), passed.alias("passed"), weight.alias("weight")
            ).alias("verdict"),
        )

    return F.array(
        entry("exact", F.lit(1.0), F.when(kind == "purchase", 1.0).otherwise(0.0), kind == "purchase"),
        entry(
            "value", F.lit(0.5), F.least(F.col("value") / 100, F.lit(1.0)),
            F.when(k % 5 != 0, F.col("value") >= 30),
        ),
        entry(
            "flaky", F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(0.25),
            F.when(~broken, (k % 10) / F.lit(10)), F.when(broken, False).otherwise(k % 10 >= 5),
        ),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per event and grader."""
    events = table(spark, sf_dir, "events").withColumn("k", _k())
    return events.select(
        (F.col("user_id") % 20).alias("eval_run_id"),
        F.col("event_id").alias("row_id"),
        F.explode(_verdict_entries()).alias("entry"),
    ).select("eval_run_id", "row_id", F.col("entry.grader").alias("grader"), "entry.verdict.*")


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.floor("c_acctbal").cast("long").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("model"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("balance "), balance)).alias("comment"),
        F.concat(F.lit("Answer as "), F.lower("c_mktsegment"), F.lit(" desk of nation "),
                 F.col("c_nationkey").cast("string")).alias("system_prompt"),
        F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tags"),
    )


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("uploads/"), F.col("n_name"), F.lit(".csv")).alias("file_path"),
        F.array(F.lit("input"), F.lit("expected_output")).alias("columns"),
    )


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with a key divisible by three owns a schedule."""
    return table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("nightly "), F.col("c_name")).alias("name"),
        F.col("c_custkey").alias("eval_config_id"),
        F.col("c_nationkey").alias("dataset_id"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(F.col("c_custkey") % 2 != 0, F.lit(0.5)).alias("min_accuracy"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as evaluation runs."""
    key = F.col("o_orderkey")
    started = F.col("o_orderdate")
    pending = key % 10 == 0
    status = (
        F.when(pending, "pending")
        .when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", "running")
        .otherwise("failed")
    )
    done = ~pending & (F.col("o_orderstatus") == "F")

    def later(unit: str, amount: Column) -> Column:
        part = {"minutes": {"mins": amount}, "hours": {"hours": amount}}[unit]
        return started + F.make_dt_interval(**part)

    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("eval_config_id"),
        F.when(key % 50 == 0, 999).otherwise(F.col("o_custkey") % 25).cast("int").alias("dataset_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("scheduled_by_id"),
        status.alias("status"),
        started.alias("created_at"),
        F.when(~pending, later("minutes", (key % 90).cast("int"))).alias("heartbeat_at"),
        F.when(done, later("hours", (key % 24).cast("int"))).alias("completed_at"),
        ((key % 101) / F.lit(100)).alias("accuracy"),
        ((key % 97) / F.lit(97)).alias("avg_score"),
        F.floor(F.col("o_totalprice") / 100).cast("long").alias("avg_latency_ms"),
        (key % 101).cast("long").alias("passed"),
        (F.lit(100) - F.least(key % 101, F.lit(100))).cast("long").alias("failed"),
        (key % 7).cast("long").alias("errors"),
        F.lit(None).cast("string").alias("error_message"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per line item, built from the row itself (no grouping)."""
    line = table(spark, sf_dir, "lineitem")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def item(part: Column, qty: Column, f: Column, s: Column) -> Column:
        return F.struct(part.alias("partkey"), qty.alias("qty"), f.alias("flag"), s.alias("status"))

    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    items = F.array(
        item(F.col("l_partkey"), F.col("l_quantity"), flag, status),
        item(F.col("l_suppkey"), F.lit(51.0) - F.col("l_quantity"), status, flag),
        item(F.col("l_partkey") + 1, F.lit(10.0), F.lit("N"), status),
    )
    context = F.to_json(
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("string").alias("ship"))
    )
    meta = F.array(
        pair("priority", F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))),
        pair("total", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
        pair("context", context),
    )
    return line.select(
        F.struct(
            F.col("l_orderkey").alias("id"),
            F.col("l_linenumber").alias("line"),
            status.alias("status"),
            (status == "O").alias("open"),
            F.slice(items, 1, (F.col("l_linenumber") % 3) + 1).alias("items"),
            meta.alias("meta"),
            F.struct(F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("rate")).alias("shipping"),
        ).alias("record")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the text of the turn that follows it; nothing (an empty text) is expected after the last."""
    turns = table(spark, sf_dir, "conversations")
    paired = with_neighbour(turns, ["conv_id"], ["turn"], ["text"], "next", following=True)
    expected = F.coalesce("next.text", F.lit(""))
    return paired.select(
        "conv_id",
        "turn",
        F.col("text").alias("input"),
        expected.alias("expected_output"),
        F.when(F.col("turn") % 4 == 0, expected).otherwise(F.lower(expected)).alias("actual_output"),
    )


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector ``i`` as expected and ``i + 1`` as actual, null after the last; ids are unique, so no key is hot."""
    vectors = table(spark, sf_dir, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").alias("expected"))
    right = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("actual"))
    return left.join(right, "vec_id", "left")


# --- the same views for the checks -------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

SQL_RESULTS = f"""
v_results AS (
  SELECT event_id, user_id % 20 AS eval_run_id,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS row_index,
    event_type AS input_data,
    CASE WHEN value >= 50 THEN 'purchase' ELSE 'view' END AS expected_output,
    CASE WHEN event_type <> 'error' THEN event_type END AS actual_output,
    CASE WHEN event_type = 'error' THEN 'API error' END AS error,
    CASE WHEN event_type <> 'error' THEN least(value / 100, 1.0) END AS score,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN value >= 30 END AS passed,
    CASE WHEN event_type <> 'error' THEN k * 10 END AS latency_ms,
    CASE WHEN event_type <> 'error' AND k % 7 <> 0 THEN k + 1 END AS input_tokens,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) END AS output_tokens,
    ts AS created_at
  FROM (SELECT *, {_K} AS k FROM events)
)"""

SQL_VERDICTS = f"""
v_base AS (SELECT *, {_K} AS k FROM events),
v_verdicts AS (
  SELECT user_id % 20 AS eval_run_id, event_id AS row_id, 'exact' AS grader,
    CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    event_type = 'purchase' AS passed, 1.0::DOUBLE AS weight FROM v_base
  UNION ALL
  SELECT user_id % 20, event_id, 'value', least(value / 100, 1.0),
    CASE WHEN k % 5 <> 0 THEN value >= 30 END, 0.5::DOUBLE FROM v_base
  UNION ALL
  SELECT user_id % 20, event_id, 'flaky',
    CASE WHEN k % 11 <> 0 THEN (k % 10) / 10::DOUBLE END,
    CASE WHEN k % 11 = 0 THEN false ELSE k % 10 >= 5 END,
    CASE WHEN user_id % 2 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END FROM v_base
)"""

SQL_ENTITIES = """
v_configs AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS model,
    CASE WHEN c_acctbal >= 0 THEN 'balance ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS comment,
    'Answer as ' || lower(c_mktsegment) || ' desk of nation ' || c_nationkey AS system_prompt,
    '["' || lower(c_mktsegment) || '", "n' || c_nationkey || '"]' AS tags_text,
    [lower(c_mktsegment), 'n' || c_nationkey] AS tags
  FROM customer),
v_datasets AS (
  SELECT n_nationkey AS id, n_name AS name, 'uploads/' || n_name || '.csv' AS file_path,
    '["input", "expected_output"]' AS columns_text
  FROM nation),
v_schedules AS (
  SELECT c_custkey AS id, 'nightly ' || c_name AS name, c_custkey AS eval_config_id,
    c_nationkey AS dataset_id, c_acctbal > 0 AS enabled,
    CASE WHEN c_custkey % 2 <> 0 THEN 0.5::DOUBLE END AS min_accuracy
  FROM customer WHERE c_custkey % 3 = 0),
v_runs AS (
  SELECT o_orderkey AS id, o_custkey AS eval_config_id,
    CAST(CASE WHEN o_orderkey % 50 = 0 THEN 999 ELSE o_custkey % 25 END AS INTEGER) AS dataset_id,
    CASE WHEN o_custkey % 3 = 0 THEN o_custkey END AS scheduled_by_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'completed'
         WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
    o_orderdate AS created_at,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + to_minutes(o_orderkey % 90) END AS heartbeat_at,
    CASE WHEN o_orderkey % 10 <> 0 AND o_orderstatus = 'F' THEN o_orderdate + to_hours(o_orderkey % 24) END AS completed_at,
    (o_orderkey % 101) / 100::DOUBLE AS accuracy, (o_orderkey % 97) / 97::DOUBLE AS avg_score,
    CAST(floor(o_totalprice / 100) AS BIGINT) AS avg_latency_ms,
    o_orderkey % 101 AS passed, 100 - least(o_orderkey % 101, 100) AS failed, o_orderkey % 7 AS errors,
    CAST(NULL AS VARCHAR) AS error_message
  FROM orders)"""

SQL_SAMPLES = """
v_samples AS (
  SELECT conv_id, turn, text AS input, next_text AS expected_output,
    CASE WHEN turn % 4 = 0 THEN next_text ELSE lower(next_text) END AS actual_output
  FROM (SELECT conv_id, turn, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS next_text
        FROM conversations))"""


def with_ctes(body: str, *ctes: str) -> str:
    """Join view definitions and a statement into one SQL text."""
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body.strip()
