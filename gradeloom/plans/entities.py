"""Queries over runs, configs, datasets and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import text
from gradeloom.functions.numbers import clamp01
from gradeloom.operators import browse, joins, maintenance, merge, page_index, trends
from gradeloom.plans import views
from gradeloom.plans.registry import query
from gradeloom.plans.views import SQL_ENTITIES, with_ctes
from gradeloom.session import fresh_dir

_VIEW = """run_view AS (
  SELECT r.*, c.name AS config_name, d.name AS dataset_name FROM v_runs r
  LEFT JOIN v_configs c ON c.id = r.eval_config_id LEFT JOIN v_datasets d ON d.id = r.dataset_id)"""


def _entity(body: str, *more: str) -> str:
    return with_ctes(body, SQL_ENTITIES, *more)


def _run_view(spark, sf):
    return joins.run_view(views.runs(spark, sf), views.configs(spark, sf), views.datasets(spark, sf))


# --- search, tags, audits -----------------------------------------------------


@query("b1_search_parts", """SELECT p_partkey, p_name FROM part
WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'""")
def b1(spark, sf):
    part = views.table(spark, sf, "part")
    pattern = text.search_pattern("  RING ")
    return part.filter(
        text.matches_any([F.col("p_name"), F.col("p_brand"), F.col("p_type")], pattern)
    ).select("p_partkey", "p_name")


_CONFIG_HIT = """(lower(name) LIKE '%{0}%' OR coalesce(lower(comment), '') LIKE '%{0}%'
  OR lower(system_prompt) LIKE '%{0}%' OR lower(model) LIKE '%{0}%' OR lower(tags_text) LIKE '%{0}%')"""


@query("b2_search_configs", _entity(f"SELECT id, name, comment FROM v_configs WHERE {_CONFIG_HIT.format('99')}"))
def b2(spark, sf):
    return browse.search_configs(views.configs(spark, sf), "99").select("id", "name", "comment")


@query("b2_search_configs_wildcard", _entity(
    f"SELECT id, name, comment FROM v_configs WHERE {_CONFIG_HIT.format('balance 1_')}"))
def b2_wild(spark, sf):
    return browse.search_configs(views.configs(spark, sf), "Balance 1_").select("id", "name", "comment")


@query("b3_search_datasets", _entity(
    """SELECT id, name FROM v_datasets WHERE lower(name) LIKE '%nation_1%' OR lower(file_path) LIKE '%nation_1%'
  OR lower(columns_text) LIKE '%nation_1%'"""))
def b3(spark, sf):
    return browse.search_datasets(views.datasets(spark, sf), "NATION_1").select("id", "name")


@query("b4_search_runs", _entity(
    """SELECT id, status, config_name, dataset_name FROM run_view
WHERE CAST(id AS VARCHAR) LIKE '%77%' OR lower(status) LIKE '%77%' OR lower(config_name) LIKE '%77%'
  OR lower(dataset_name) LIKE '%77%'""", _VIEW))
def b4(spark, sf):
    return browse.search_runs(_run_view(spark, sf), "77").select(
        "id", "status", "config_name", "dataset_name")


@query("b5_any_tag", _entity(
    "SELECT id, name FROM v_configs WHERE lower(tags_text) LIKE '%build%' OR lower(tags_text) LIKE '%n1%'"))
def b5(spark, sf):
    return browse.search_configs(views.configs(spark, sf), tags=["Build", " ", "n1"]).select("id", "name")


@query("b5_whole_tags", _entity(
    "SELECT id, name FROM v_configs WHERE list_contains(tags, 'building') OR list_contains(tags, 'n1')"))
def b5_exact(spark, sf):
    return browse.search_configs(
        views.configs(spark, sf), tags=["building", "n1"], whole_tags=True).select("id", "name")


_NOW = "TIMESTAMP '1998-01-01 00:20:00'"


@query("b7_fail_stale_runs", _entity(
    f"""SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
  CASE WHEN stale THEN '{browse.STALE_MESSAGE}' ELSE error_message END AS error_message,
  CASE WHEN stale THEN {_NOW} ELSE completed_at END AS completed_at,
  CASE WHEN stale THEN {_NOW} ELSE heartbeat_at END AS heartbeat_at
FROM (SELECT *, status IN ('pending', 'running', 'finalizing')
  AND coalesce(heartbeat_at, created_at) < {_NOW} - INTERVAL 30 MINUTE AS stale FROM v_runs)"""))
def b7(spark, sf):
    now = F.lit("1998-01-01 00:20:00").cast("timestamp_ntz")
    return browse.fail_stale(views.runs(spark, sf), now).select(
        "id", "status", "error_message", "completed_at", "heartbeat_at")


@query("b8_run_view", _entity(
    "SELECT id, eval_config_id, dataset_id, status, created_at, completed_at, config_name, dataset_name FROM run_view",
    _VIEW))
def b8(spark, sf):
    return _run_view(spark, sf).select(
        "id", "eval_config_id", "dataset_id", "status", "created_at", "completed_at",
        "config_name", "dataset_name")


@query("b9_prompt_preview", """SELECT doc_id, CASE WHEN length(text) <= 240 THEN text
  ELSE regexp_replace(substring(text, 1, 240), '\\s+$', '') || '...' END AS preview FROM documents""")
def b9(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", text.preview(F.col("text")).alias("preview"))


@query("b10_bounded_message", r"""
SELECT doc_id, CASE WHEN length(m) <= 2000 THEN m ELSE substring(m, 1, 1997) || '...' END AS message
FROM (SELECT doc_id, 'Run failed during evaluation: ' || source || CASE WHEN t = '' THEN '' ELSE ': ' || t END AS m
  FROM (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents))""")
def b10(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id",
        text.bounded_message(
            F.lit("Run failed during evaluation"), F.col("source"), F.col("text")).alias("message"))


@query("b12_below_threshold", _entity(
    """SELECT r.id, coalesce(r.accuracy < s.min_accuracy, false) AS below_threshold
FROM v_runs r JOIN v_schedules s ON s.id = r.scheduled_by_id"""))
def b12(spark, sf):
    limits = views.schedules(spark, sf).select(F.col("id").alias("scheduled_by_id"), "min_accuracy")
    runs = views.runs(spark, sf).filter(F.col("scheduled_by_id").isNotNull())
    joined = joins.lookup_join(runs, limits, ["scheduled_by_id"], "inner", spread_by=["id"])
    return joined.select(
        "id", browse.below_threshold(F.col("accuracy"), F.col("min_accuracy")).alias("below_threshold"))


@query("b13_enabled_schedules", _entity("SELECT id, name FROM v_schedules WHERE enabled"))
def b13(spark, sf):
    return views.schedules(spark, sf).filter("enabled").select("id", "name")


def _grader_lists(spark, sf):
    """A grader list per part, some of them invalid on purpose."""
    kinds = F.array(*[F.lit(t) for t in (*browse.GRADER_TYPES, "llm")])
    size = F.col("p_size")

    def grader(name, kind, weight, schema):
        return F.struct(
            name.alias("name"), kind.alias("type"), weight.alias("weight"), schema.alias("schema"))

    first = grader(
        F.col("p_brand"), F.get(kinds, (size % 7).cast("int")), size / F.lit(40),
        F.when(size % 2 == 0, "{}"))
    second = grader(
        F.when(size % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.lit("python"),
        F.lit(1.0), F.lit(None).cast("string"))
    return views.table(spark, sf, "part").select(
        "p_partkey", "p_size", F.slice(F.array(first, second), 1, (size % 3).cast("int")).alias("graders"))


@query("b14_grader_audit", """
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN n = 0 THEN 'no_graders' END,
  CASE WHEN n = 2 AND (p_size % 5 = 0 OR p_brand = p_type) THEN 'duplicate_names' END,
  CASE WHEN n >= 1 AND NOT p_size / 40::DOUBLE BETWEEN 0 AND 1 THEN 'weight_out_of_range' END,
  CASE WHEN n >= 1 AND p_size % 7 = 6 THEN 'unknown_type' END,
  CASE WHEN n >= 1 AND p_size % 7 = 4 AND p_size % 2 <> 0 THEN 'schema_missing' END
], lambda x: x IS NOT NULL), ',') AS violations,
  CASE WHEN n >= 1 THEN CASE p_size % 7 WHEN 3 THEN 0.8 WHEN 4 THEN 1.0 ELSE 0.7 END::DOUBLE END AS default_threshold
FROM (SELECT *, p_size % 3 AS n FROM part)""")
def b14(spark, sf):
    kind = F.get("graders", 0)["type"]
    return _grader_lists(spark, sf).select(
        "p_partkey",
        F.array_join(browse.grader_violations(F.col("graders")), ",").alias("violations"),
        F.when(F.size("graders") > 0, browse.default_threshold(kind)).alias("default_threshold"))


@query("b15_mapping_audit", """
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_size % 3 = 0 THEN 'missing_input' END,
  CASE WHEN p_size % 4 = 0 THEN 'missing_expected_output' END,
  CASE WHEN p_size % 5 = 0 THEN 'empty_key' END,
  CASE WHEN p_size % 6 = 0 THEN 'empty_value' END], lambda x: x IS NOT NULL), ',') AS violations
FROM part""")
def b15(spark, sf):
    size = F.col("p_size")
    mapping = F.map_from_arrays(
        F.array(
            F.when(size % 3 == 0, "in").otherwise("input"),
            F.when(size % 4 == 0, "out").otherwise("expected_output"),
            F.when(size % 5 == 0, "").otherwise("label")),
        F.array(F.col("p_name"), F.col("p_brand"), F.when(size % 6 == 0, "").otherwise("x")))
    return views.table(spark, sf, "part").select(
        "p_partkey", F.array_join(browse.mapping_violations(mapping), ",").alias("violations"))


@query("b16_config_page", _entity(
    f"""SELECT id, name FROM (SELECT *, DATE '2024-01-01' + CAST(id // 7 AS INTEGER) AS created_at FROM v_configs)
WHERE {_CONFIG_HIT.format('balance')} AND lower(tags_text) LIKE '%machinery%'
ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10"""))
def b16(spark, sf):
    found = browse.search_configs(views.configs(spark, sf), "balance", ["MACHINERY"])
    dated = found.withColumn("created_at", F.date_add(F.lit("2024-01-01"), F.floor(F.col("id") / 7).cast("int")))
    return browse.page(dated, 2, 10).select("id", "name")


@query("d7_distinct_tags", _entity("SELECT DISTINCT unnest(tags) AS tag FROM v_configs"))
def d7(spark, sf):
    return views.configs(spark, sf).select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


# --- joins and latest runs ------------------------------------------------------


@query("c1_run_names", _entity("SELECT id, config_name, dataset_name FROM run_view", _VIEW))
def c1(spark, sf):
    return _run_view(spark, sf).select("id", "config_name", "dataset_name")


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY scheduled_by_id ORDER BY created_at DESC, id DESC) AS rn
  FROM v_runs WHERE scheduled_by_id IS NOT NULL) WHERE rn = 1)"""


@query("e1_latest_run_per_schedule", _entity(
    "SELECT id, scheduled_by_id, status, created_at FROM latest", _LATEST))
def e1(spark, sf):
    wanted = views.runs(spark, sf).select("id", "scheduled_by_id", "status", "created_at")
    return trends.latest_run(wanted)


@query("c2_latest_run_rows", _entity(
    "SELECT id, scheduled_by_id, accuracy, avg_score, completed_at FROM latest", _LATEST))
def c2(spark, sf):
    wanted = views.runs(spark, sf).select(
        "id", "scheduled_by_id", "created_at", "accuracy", "avg_score", "completed_at")
    return trends.latest_run(wanted).drop("created_at")


@query("c10_schedule_view", _entity(
    """SELECT s.id, s.name, c.name AS config_name, d.name AS dataset_name, l.id AS last_run_id,
  l.status AS last_status, l.accuracy AS last_accuracy, l.completed_at AS last_completed_at
FROM v_schedules s LEFT JOIN latest l ON l.scheduled_by_id = s.id
LEFT JOIN v_configs c ON c.id = s.eval_config_id LEFT JOIN v_datasets d ON d.id = s.dataset_id""", _LATEST))
def c10(spark, sf):
    wanted = views.runs(spark, sf).select(
        "id", "scheduled_by_id", "created_at", "status", "accuracy", "completed_at")
    last = trends.latest_run(wanted).select(
        F.col("scheduled_by_id").alias("id"),
        F.col("id").alias("last_run_id"),
        F.col("status").alias("last_status"),
        F.col("accuracy").alias("last_accuracy"),
        F.col("completed_at").alias("last_completed_at"))
    named = joins.run_view(
        views.schedules(spark, sf), views.configs(spark, sf), views.datasets(spark, sf))
    return named.join(last, "id", "left").select(
        "id", "name", "config_name", "dataset_name", "last_run_id", "last_status",
        "last_accuracy", "last_completed_at")


_PREVIOUS = """pairs AS (SELECT *, lag(id) OVER w AS p_id, lag(accuracy) OVER w AS p_accuracy,
    lag(avg_score) OVER w AS p_score, lag(avg_latency_ms) OVER w AS p_latency
  FROM v_runs WHERE status = 'completed' AND scheduled_by_id IS NOT NULL
  WINDOW w AS (PARTITION BY scheduled_by_id ORDER BY completed_at, id))"""


@query("e2_previous_completed_run", _entity(
    "SELECT id, scheduled_by_id, p_id AS previous_id, p_accuracy AS previous_accuracy FROM pairs", _PREVIOUS))
def e2(spark, sf):
    pairs = trends.previous_completed(views.runs(spark, sf), ["id", "accuracy"])
    return pairs.select(
        "id", "scheduled_by_id", F.col("previous.id").alias("previous_id"),
        F.col("previous.accuracy").alias("previous_accuracy"))


def _sql_magnitude(expr: str, decimals: int) -> str:
    return f"regexp_replace(regexp_replace(printf('%.{decimals}f', abs({expr})), '0+$', ''), '\\.$', '')"


def _sql_delta(cur: str, prev: str, unit: str, scale: str, decimals: int, better: str) -> str:
    d, s = f"({cur} - {prev})", f"(({cur} - {prev}) * {scale}::DOUBLE)"
    return f"""CASE WHEN {prev} IS NULL THEN '' WHEN abs({s}) < {10 ** -decimals / 2!r}::DOUBLE THEN ' •' ELSE ' ' ||
    CASE WHEN {d} {better} 0 THEN '🟢' ELSE '🔴' END || ' ' || CASE WHEN {d} > 0 THEN '▲ +' ELSE '▼ -' END ||
    {_sql_magnitude(s, decimals)} || '{unit}' END"""


def _sql_direction(cur: str, prev: str, scale: str, decimals: int) -> str:
    d = f"({cur} - {prev})"
    return f"""CASE WHEN {prev} IS NULL THEN NULL WHEN abs({d} * {scale}::DOUBLE) < {10 ** -decimals / 2!r}::DOUBLE THEN 'flat'
    WHEN {d} > 0 THEN 'up' ELSE 'down' END"""


_TREND = f"""SELECT id, accuracy - p_accuracy AS accuracy_delta, avg_score - p_score AS score_delta,
  avg_latency_ms - p_latency AS latency_delta,
  {_sql_direction('accuracy', 'p_accuracy', '100', 1)} AS accuracy_trend,
  {_sql_direction('avg_score', 'p_score', '1', 3)} AS score_trend,
  {_sql_direction('avg_latency_ms', 'p_latency', '1', 1)} AS latency_trend,
  printf('%.1f', accuracy * 100) || '%' || {_sql_delta('accuracy', 'p_accuracy', 'pp', '100', 1, '>')} AS accuracy_text,
  printf('%.3f', avg_score) || {_sql_delta('avg_score', 'p_score', '', '1', 3, '>')} AS score_text,
  avg_latency_ms || ' ms' || {_sql_delta('avg_latency_ms', 'p_latency', 'ms', '1', 1, '<')} AS latency_text"""


@query("e3_trend_deltas", _entity(f"{_TREND} FROM pairs", _PREVIOUS))
def e3(spark, sf):
    pairs = trends.previous_completed(
        views.runs(spark, sf), ["accuracy", "avg_score", "avg_latency_ms"])
    return trends.trend(pairs).select(
        "id", "accuracy_delta", "score_delta", "latency_delta", "accuracy_trend", "score_trend",
        "latency_trend", "accuracy_text", "score_text", "latency_text")


@query("s20_alert_table", _entity(
    f"""SELECT t.id AS run_id, p.scheduled_by_id, coalesce(p.accuracy < s.min_accuracy, false) AS below_threshold,
  CASE WHEN coalesce(p.accuracy < s.min_accuracy, false) THEN '🚨 ' ELSE '✅ ' END || s.name AS header,
  t.accuracy_text, t.score_text, t.latency_text,
  p.passed || ' / ' || p.failed || ' / ' || p.errors AS counts_text
FROM ({_TREND} FROM pairs) t JOIN pairs p ON p.id = t.id JOIN v_schedules s ON s.id = p.scheduled_by_id""", _PREVIOUS))
def s20(spark, sf):
    return trends.alert_table(
        views.runs(spark, sf), views.schedules(spark, sf), views.configs(spark, sf),
        views.datasets(spark, sf), "https://eval.example").drop("message")


@query("c9_cascade_delete", """
SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def c9(spark, sf):
    gone = views.table(spark, sf, "customer").filter("c_acctbal < 0")
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return joins.delete_cascade(orders, gone, "o_custkey", "c_custkey", spread_by=["id"]).select("id", "o_custkey")


@query("c9_restricted_delete", """
SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders) AS blocked FROM customer""")
def c9_restrict(spark, sf):
    parents = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return joins.delete_restricted(parents, views.table(spark, sf, "orders"), "o_custkey")


@query("c9_set_null_delete", _entity(
    """SELECT r.id, CASE WHEN s.id IS NULL THEN r.scheduled_by_id END AS scheduled_by_id
FROM v_runs r LEFT JOIN (SELECT id FROM v_schedules WHERE NOT enabled) s ON s.id = r.scheduled_by_id"""))
def c9_null(spark, sf):
    gone = views.schedules(spark, sf).filter(~F.col("enabled"))
    runs = views.runs(spark, sf).select("id", "scheduled_by_id")
    return joins.delete_set_null(runs, gone, "scheduled_by_id", spread_by=["id"]).select("id", "scheduled_by_id")


# --- sorting and paging ---------------------------------------------------------


@query("f1_newest_first", _entity("SELECT id, created_at FROM v_runs ORDER BY created_at DESC, id DESC"))
def f1(spark, sf):
    return browse.newest_first(views.runs(spark, sf).select("id", "created_at"))


@query("f2_page", _entity(
    "SELECT id, status, created_at FROM v_runs ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50"))
def f2(spark, sf):
    return browse.page(views.runs(spark, sf).select("id", "status", "created_at"), 3, 25)


@query("f2_deep_page", _entity(
    "SELECT id, status, created_at FROM v_runs ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 12000"))
def f2_deep(spark, sf):
    return browse.page(views.runs(spark, sf).select("id", "status", "created_at"), 121, 100)


@query("f2_indexed_page", _entity(
    "SELECT id, status, created_at FROM v_runs ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 7000"))
def f2_indexed(spark, sf):
    path = fresh_dir(spark, "pages")
    page_index.write_page_index(views.runs(spark, sf).select("id", "status", "created_at"), path)
    return page_index.indexed_page(spark, path, 71, 100)


@query("f3_recent_runs", _entity(
    "SELECT id, config_name, dataset_name FROM run_view ORDER BY created_at DESC, id DESC LIMIT 10", _VIEW))
def f3(spark, sf):
    newest = browse.newest_first(views.runs(spark, sf)).limit(10)
    return joins.run_view(newest, views.configs(spark, sf), views.datasets(spark, sf)).select(
        "id", "config_name", "dataset_name")


@query("f4_latest_run", _entity(
    "SELECT id, scheduled_by_id, created_at FROM v_runs WHERE scheduled_by_id = 33 ORDER BY created_at DESC, id DESC LIMIT 1"))
def f4(spark, sf):
    runs = views.runs(spark, sf).filter(F.col("scheduled_by_id") == 33)
    return browse.newest_first(runs).limit(1).select("id", "scheduled_by_id", "created_at")


@query("f7_page_clamp", _entity(
    """SELECT status, count(*) AS total, CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT) AS pages,
  least(200, CAST(greatest(ceil(count(*) / 25.0), 1) AS BIGINT)) AS page FROM v_runs GROUP BY status"""))
def f7(spark, sf):
    counted = views.runs(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("total"))
    pages = browse.page_counts(F.col("total"), F.lit(25))
    return counted.select("status", "total", pages.alias("pages"),
                          F.least(F.lit(200).cast("long"), pages).alias("page"))


# --- keyed unions ---------------------------------------------------------------


@query("su1_append_rows", """
SELECT input, expected_output, note FROM (
  SELECT p_name AS input, p_brand AS expected_output, p_type AS note FROM part
  UNION ALL SELECT s_name, CAST(s_nationkey AS VARCHAR), '' FROM supplier)""")
def su1(spark, sf):
    old = views.table(spark, sf, "part").select(
        F.col("p_name").alias("input"), F.col("p_brand").alias("expected_output"), F.col("p_type").alias("note"))
    new = views.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("expected_output"), F.col("s_name").alias("input"))
    return merge.append_rows(old, new, ["input", "expected_output", "note"])


_BASKET = """basket AS (SELECT 'p' || p_partkey % 1500 AS sel, p_partkey AS pos, p_name AS name FROM part),
items AS (SELECT 'p' || s_suppkey * 31 AS sel, s_suppkey AS pos, s_name AS name FROM supplier)"""


def _basket(spark, sf):
    basket = views.table(spark, sf, "part").select(
        F.concat(F.lit("p"), (F.col("p_partkey") % 1500).cast("string")).alias("sel"),
        F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    items = views.table(spark, sf, "supplier").select(
        F.concat(F.lit("p"), (F.col("s_suppkey") * 31).cast("string")).alias("sel"),
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return basket, items


@query("su2_merge_basket", with_ctes(
    """SELECT sel, CAST(min(late) AS INTEGER) AS appended, arg_min(pos, late * 1000000000 + pos) AS pos,
  arg_max(name, late * 1000000000 + pos) AS name
FROM (SELECT *, 0 AS late FROM basket UNION ALL SELECT *, 1 FROM items) GROUP BY sel""", _BASKET))
def su2(spark, sf):
    return merge.merge_basket(*_basket(spark, sf), "sel", "pos", ["name"])


@query("c6_remove_items", with_ctes(
    "SELECT sel, pos, name FROM basket WHERE sel NOT IN (SELECT sel FROM items)", _BASKET))
def c6(spark, sf):
    return merge.remove_items(*_basket(spark, sf), "sel").select("sel", "pos", "name")


@query("c6_count_selected", with_ctes(
    "SELECT count(*) AS selected FROM items WHERE sel IN (SELECT sel FROM basket)", _BASKET))
def c6_count(spark, sf):
    return merge.count_selected(*_basket(spark, sf), "sel")


# --- display and text -------------------------------------------------------------


@query("s2_export_names", """
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'),
  '^[-._]+|[-._]+$', '', 'g'), ''), 'dataset') AS file_name FROM pages""")
def s2(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", text.export_file_name(F.col("url"), "dataset").alias("file_name"))


@query("s3_grader_keys", """
SELECT p_partkey, 'grader_' || coalesce(nullif(lower(regexp_replace(regexp_replace(n, '[^A-Za-z0-9]+', '_', 'g'),
  '^_+|_+$', '', 'g')), ''), 'unknown') AS grader_key
FROM (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN '##' ELSE 'custom: ' || p_name || ' (' || p_brand || ')' END AS n FROM part)""")
def s3(spark, sf):
    name = F.when(F.col("p_size") % 10 == 0, "##").otherwise(
        F.concat(F.lit("custom: "), "p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return views.table(spark, sf, "part").select("p_partkey", text.grader_key(name).alias("grader_key"))


@query("s3_grader_key_collisions", """
SELECT grader_key, count(*) AS names FROM (
  SELECT 'grader_' || lower(regexp_replace(regexp_replace(n, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS grader_key
  FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) || '!' END AS n FROM part))
GROUP BY 1 HAVING count(*) > 1""")
def s3_audit(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(
        F.concat(F.upper("p_name"), F.lit("!")))
    names = views.table(spark, sf, "part").select(name.alias("name")).distinct()
    return names.groupBy(text.grader_key(F.col("name")).alias("grader_key")).agg(
        F.count(F.lit(1)).alias("names")).filter("names > 1")


@query("s5_cache_keys", "SELECT doc_id, sha256('dutch' || chr(0) || text) AS cache_key FROM documents")
def s5(spark, sf):
    language = F.lit(text.language_key("  Dutch "))
    return views.table(spark, sf, "documents").select(
        "doc_id", text.cache_key(language, F.col("text")).alias("cache_key"))


@query("s6_language_keys", "SELECT doc_id, lower(trim('  ' || upper(lang) || ' ')) AS language FROM documents")
def s6(spark, sf):
    shown = F.concat(F.lit("  "), F.upper("lang"), F.lit(" "))
    return views.table(spark, sf, "documents").select(
        "doc_id", F.lower(text.strip(shown)).alias("language"))


@query("s13_format_names", """
SELECT p_partkey, regexp_replace(p_name || ' ' || p_brand, '[^a-zA-Z0-9_-]', '_', 'g') AS format_name FROM part""")
def s13(spark, sf):
    return views.table(spark, sf, "part").select(
        "p_partkey", text.format_name(F.concat_ws(" ", "p_name", "p_brand")).alias("format_name"))


@query("s14_display_text", """
SELECT event_id, printf('%.1f', value / 100 * 100) || '%' AS percent,
  CASE WHEN ms < 1000 THEN CAST(floor(ms + 0.5) AS BIGINT) || ' ms' ELSE printf('%.2f', ms / 1000) || ' s' END AS latency,
  CASE WHEN tokens >= 1000000 THEN printf('%.1f', tokens / 1000000::DOUBLE + CASE WHEN tokens % 1000000 = 250000 THEN 0.01 ELSE 0 END) || 'M'
       WHEN tokens >= 1000 THEN printf('%.1f', tokens / 1000::DOUBLE + CASE WHEN tokens % 1000 = 250 THEN 0.01 ELSE 0 END) || 'k' ELSE tokens || '' END AS tokens
FROM (SELECT event_id, value, value * 17.003 AS ms, event_id * 137 AS tokens FROM events)""")
def s14(spark, sf):
    events = views.table(spark, sf, "events")
    return events.select(
        "event_id",
        text.percent_text(F.col("value") / 100).alias("percent"),
        text.latency_text(F.col("value") * 17.003).alias("latency"),
        text.tokens_text(F.col("event_id") * 137).alias("tokens"))


@query("s15_magnitudes", r"""
SELECT event_id, regexp_replace(regexp_replace(printf('%.1f', abs(value - 40)), '0+$', ''), '\.$', '') AS one,
  regexp_replace(regexp_replace(printf('%.3f', abs(value / 16)), '0+$', ''), '\.$', '') AS three FROM events""")
def s15(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id",
        text.magnitude_text(F.col("value") - 40, 1).alias("one"),
        text.magnitude_text(F.col("value") / 16, 3).alias("three"))


@query("s16_schema_names", r"""
SELECT doc_id, coalesce(nullif(array_to_string(list_transform(list_filter(
  string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1:3],
  lambda w: regexp_full_match(w, '[\p{L}\p{N}]+')), lambda w: lower(w)), '_'), ''), 'response') AS schema_name FROM documents""")
def s16(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", text.schema_name(F.col("text")).alias("schema_name"))


@query("s17_strip_fences", r"""
SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN regexp_replace(array_to_string(list_filter(
  string_split_regex(t, '\r\n|[\n\r]'), lambda l: NOT starts_with(regexp_replace(l, '^\s+', ''), '```')), chr(10)),
  '^\s+|\s+$', '', 'g') ELSE t END AS body
FROM (SELECT conv_id, turn, regexp_replace(
  CASE WHEN turn % 2 = 0 THEN '```json' || chr(10) || text || chr(10) || '  ```' ELSE text END, '^\s+|\s+$', '', 'g') AS t
  FROM conversations)""")
def s17(spark, sf):
    reply = F.when(
        F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n  ```"))
    ).otherwise(F.col("text"))
    return views.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.strip_fences(reply).alias("body"))


@query("s18_clamp", "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 60 - 0.2)) AS score FROM events")
def s18(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", clamp01(F.col("value") / 60 - 0.2).alias("score"))


@query("s19_comments", r"""
SELECT doc_id, nullif(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END, '^\s+|\s+$', '', 'g'), '') AS comment
FROM documents""")
def s19(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text"))
    return views.table(spark, sf, "documents").select(
        "doc_id", text.blank_to_null(raw).alias("comment"))


# --- maintenance --------------------------------------------------------------------


@query("k1_legacy_graders", """
WITH legacy AS (SELECT p_partkey, p_size,
  list_filter([CASE WHEN p_size % 2 = 0 THEN 'json_field_match' ELSE 'exact_match' END,
    CASE WHEN p_size % 3 = 0 THEN 'semantic_similarity' ELSE 'llm_judge' END],
    lambda x: x IN ('json_field_match', 'semantic_similarity')) AS names FROM part)
SELECT p_partkey, array_to_string(list_concat(list_transform(names, lambda x: CASE x
    WHEN 'json_field_match' THEN 'json_field_match:json_field:0.7:' || (p_size / 10::DOUBLE)
    ELSE 'semantic_similarity:semantic_similarity:0.8:' END),
  ['clarity:prompt:0.7:0.25']), '|') AS graders
FROM legacy""")
def k1(spark, sf):
    size = F.col("p_size")
    comparers = F.concat(
        F.when(size % 2 == 0, "json_field_match").otherwise("exact_match"), F.lit(" , "),
        F.when(size % 3 == 0, "semantic_similarity").otherwise("llm_judge"))
    weights = F.create_map(
        F.lit("json_field_match"), size / F.lit(10.0), F.lit("custom:clarity"), F.lit(0.25))
    custom = F.array(F.struct(
        F.lit("clarity").alias("name"), F.lit("Rate it").alias("prompt"),
        F.lit(0.7).alias("threshold"), F.lit(1.0).alias("weight")))
    shown = F.transform(
        maintenance.unify_graders(comparers, weights, custom),
        lambda g: F.concat_ws(
            ":", g["name"], g["type"], g["threshold"].cast("string"),
            F.coalesce(g["weight"].cast("string"), F.lit(""))))
    return views.table(spark, sf, "part").select("p_partkey", F.array_join(shown, "|").alias("graders"))


@query("k2_heartbeat_backfill", _entity(
    "SELECT id, coalesce(heartbeat_at, completed_at, created_at) AS heartbeat_at FROM v_runs"))
def k2(spark, sf):
    runs = views.runs(spark, sf).withColumn("started_at", F.col("completed_at"))
    return maintenance.backfill_heartbeats(runs).select("id", "heartbeat_at")


@query("k3_duplicate_sources", """
SELECT kind, id, name, parent FROM (
  SELECT 'source' AS kind, 'copy-' || s_suppkey AS id, s_name || ' copy' AS name, NULL AS parent FROM supplier
  UNION ALL
  SELECT 'preset', 'copy-' || p_partkey, p_name, 'copy-' || s_suppkey
  FROM part JOIN supplier ON s_suppkey = (SELECT min(s_suppkey) FROM supplier) + p_partkey % (SELECT count(*) FROM supplier))""")
def k3(spark, sf):
    def copy_id(column):
        return F.concat(F.lit("copy-"), F.col(column).cast("string"))

    sources = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    first, count = sources.agg(F.min("id"), F.count("id")).first()
    presets = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        (F.col("p_partkey") % count + first).alias("source_id"))
    parents = maintenance.duplicate_parents(sources, copy_id("id"))
    children = maintenance.duplicate_children(presets, sources, "source_id", copy_id("id"), copy_id("id"))
    return parents.select(
        F.lit("source").alias("kind"), "id", "name", F.lit(None).cast("string").alias("parent")
    ).unionByName(children.select(
        F.lit("preset").alias("kind"), "id", "name", F.col("source_id").alias("parent")))
