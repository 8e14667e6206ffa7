"""Queries over whole flows: fan-out, export, upserts, translation, discovery, streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gradeloom.functions.json_text import canonical_json
from gradeloom.functions.text import cache_key
from gradeloom.operators import compare, discover, joins, translate
from gradeloom.operators import graders as grading
from gradeloom.plans import views
from gradeloom.plans.aggregates import _SUMMARY
from gradeloom.plans.mappings import _ITEMS
from gradeloom.plans.registry import query
from gradeloom.plans.views import SQL_ENTITIES, SQL_RESULTS, SQL_VERDICTS, with_ctes
from gradeloom.session import cut_lineage, fresh_dir
from gradeloom.sources import csv_dataset, exports, paging, records, split_csv
from gradeloom.sources.keyed_table import results_table, translation_cache
from gradeloom.sources.paged_json import register_paged_json
from gradeloom.streaming import grade_stream, heartbeat, paged_stream, running

# --- fan-out and export -----------------------------------------------------------


@query("c7_evaluation_rows", """
SELECT c_custkey AS eval_run_id, o_custkey AS dataset_id, o_orderkey AS row_index, o_orderpriority AS input
FROM customer JOIN orders ON o_custkey = c_custkey""")
def c7(spark, sf):
    runs = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("dataset_id"))
    rows = views.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("row_index"), F.col("o_orderpriority").alias("input"))
    return joins.evaluation_rows(runs, rows).select("eval_run_id", "dataset_id", "row_index", "input")


_RUN_VIEW = """run_view AS (SELECT r.*, c.name AS config_name, d.name AS dataset_name FROM v_runs r
  LEFT JOIN v_configs c ON c.id = r.eval_config_id LEFT JOIN v_datasets d ON d.id = r.dataset_id)"""


def _run_view(spark, sf):
    runs = joins.run_view(views.runs(spark, sf), views.configs(spark, sf), views.datasets(spark, sf))
    digest = F.when(F.col("status") == "completed", F.struct("passed", "failed", "accuracy", "avg_latency_ms"))
    return runs.select(
        "id", "status", "config_name", "dataset_name", "created_at", F.col("heartbeat_at").alias("started_at"),
        "completed_at", digest.alias("summary"))


@query("c8_result_enrichment", with_ctes(
    """SELECT event_id, row_index, score, v.id AS eval_run_id, v.status, v.config_name, v.dataset_name
FROM v_results r JOIN run_view v ON v.id = r.eval_run_id""", SQL_RESULTS, SQL_ENTITIES, _RUN_VIEW))
def c8(spark, sf):
    results = views.results(spark, sf, indexed=True).select(
        "event_id", "row_index", "score", "eval_run_id", F.col("event_id").alias("result_id"))
    side = _run_view(spark, sf).select(F.col("id").alias("eval_run_id"), "status", "config_name", "dataset_name")
    return exports.enrich_results(results, side).drop("result_id")


_DATE = "strftime({0}, '%Y-%m-%d %H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE strftime({0}, '.%f') END"


def _grader_sql(name: str) -> str:
    one = f"max(CASE WHEN grader = '{name}' THEN {{0}} END)"
    return f"""coalesce({one.format("CAST(score AS VARCHAR)")}, '') AS {name}_score,
    coalesce({one.format("CASE WHEN passed THEN 'True' WHEN NOT passed THEN 'False' END")}, '') AS {name}_passed,
    coalesce({one.format("detail")}, '') AS {name}_detail"""


_EXPORT_DETAIL = f"""detail AS (SELECT row_id, {_grader_sql("exact")}, {_grader_sql("flaky")}, {_grader_sql("value")} FROM (
  SELECT *, '{{"passed": ' || coalesce(CAST(passed AS VARCHAR), 'null') || CASE WHEN score IS NULL THEN '' ELSE ', "score": ' || score END
    || ', "weight": ' || weight || '}}' AS detail FROM v_verdicts) GROUP BY row_id)"""

_EXPORT_SQL = f"""SELECT CAST(v.id AS VARCHAR) AS run_id, v.status AS run_status, coalesce(v.config_name, '') AS config_name,
  coalesce(v.dataset_name, '') AS dataset_name, {_DATE.format("v.created_at")} AS run_created_at,
  coalesce({_DATE.format("v.heartbeat_at")}, '') AS run_started_at, coalesce({_DATE.format("v.completed_at")}, '') AS run_completed_at,
  CASE WHEN v.status <> 'completed' THEN '' ELSE '{{"accuracy": ' || v.accuracy || ', "avg_latency_ms": ' || v.avg_latency_ms
    || ', "failed": ' || v.failed || ', "passed": ' || v.passed || '}}' END AS run_summary_json,
  CAST(event_id AS VARCHAR) AS result_id, CAST(row_index AS VARCHAR) AS row_index, input_data, expected_output,
  coalesce(actual_output, '') AS actual_output, CASE WHEN r.passed THEN 'True' WHEN NOT r.passed THEN 'False' ELSE '' END AS passed,
  coalesce(CAST(r.score AS VARCHAR), '') AS comparer_score, coalesce(CAST(latency_ms AS VARCHAR), '') AS latency_ms,
  coalesce(CAST(input_tokens AS VARCHAR), '') AS input_tokens, coalesce(CAST(output_tokens AS VARCHAR), '') AS output_tokens,
  coalesce(error, '') AS error,
  '{{"exact": ' || exact_detail || ', "flaky": ' || flaky_detail || ', "value": ' || value_detail || '}}' AS comparer_details_json,
  CASE WHEN input_tokens IS NULL AND output_tokens IS NULL THEN '' ELSE '{{' || concat_ws(', ', '"input_tokens": ' || input_tokens,
    '"output_tokens": ' || output_tokens) || '}}' END AS token_usage_json, {_DATE.format("r.created_at")} AS result_created_at,
  {", ".join(f"{g}_score AS grader_{g}_score, {g}_passed AS grader_{g}_passed, '' AS grader_{g}_reasoning, {g}_detail AS grader_{g}_details_json" for g in ("exact", "flaky", "value"))}
FROM v_results r JOIN run_view v ON v.id = r.eval_run_id JOIN detail ON row_id = event_id"""


@query("a7_run_export", with_ctes(_EXPORT_SQL, SQL_RESULTS, SQL_VERDICTS, SQL_ENTITIES, _RUN_VIEW, _EXPORT_DETAIL))
def a7(spark, sf):
    results = views.results(spark, sf, indexed=True, details=True).withColumn("result_id", F.col("event_id"))
    return exports.run_export(results, _run_view(spark, sf), names_from=views.results(spark, sf, details=True))


@query("s4_canonical_json", """
SELECT p_partkey, '{"a": [1, ' || p_size || '], "b": "' || p_name || '", "price": ' || p_retailprice || '}' AS body FROM part""")
def s4(spark, sf):
    part = views.table(spark, sf, "part").select(
        "p_partkey", F.struct(
            F.col("p_retailprice").alias("price"), F.col("p_name").alias("b"), F.array(F.lit(1), F.col("p_size")).alias("a"),
            F.lit(None).cast("string").alias("absent")).alias("s"))
    return part.select("p_partkey", canonical_json(F.col("s"), part.schema["s"].dataType).alias("body"))


# --- files and pages --------------------------------------------------------------------


@query("a1_csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS input, lang AS expected_output, '' AS note FROM documents""")
def a1(spark, sf):
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("input"), F.col("lang").alias("expected_output"))
    path = fresh_dir(spark, "dataset")
    csv_dataset.write_dataset(docs, path, ["doc_id", "input", "expected_output", "note"])
    return csv_dataset.check_dataset(csv_dataset.read_dataset(spark, path))


@query("a1_split_files", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, text AS input, lang AS expected_output, '' AS note FROM documents""")
def a1_split(spark, sf):
    """Texts with quotes and line breaks; every file is read by many tasks."""
    docs = views.table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("input"), F.col("lang").alias("expected_output"))
    path = fresh_dir(spark, "dataset")
    csv_dataset.write_dataset(docs, path, ["doc_id", "input", "expected_output", "note"])
    return csv_dataset.check_dataset(split_csv.read_split_dataset(spark, path))


@query("a10_overwrite_rows", """
SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS input, p_type AS expected_output, (SELECT count(*) FROM part) AS n_rows FROM part""")
def a10(spark, sf):
    """A dataset of customers is replaced by one of parts, which has other columns."""
    path, columns = fresh_dir(spark, "dataset"), ["part", "input", "expected_output"]
    old = views.table(spark, sf, "customer").select(
        F.col("c_name").alias("input"), F.col("c_mktsegment").alias("expected_output"), "c_custkey")
    csv_dataset.write_dataset(old, path, ["input", "expected_output", "c_custkey"])
    new = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_name").alias("input"), F.col("p_type").alias("expected_output"))
    count = csv_dataset.overwrite_rows(new, path, columns)
    return csv_dataset.read_dataset(spark, path).withColumn("n_rows", F.lit(count).cast("long"))


SERVED_ROWS = 10_000  # rows of a file of the stand-in for a remote service


def _customer_pages(spark, sf):
    """A stand-in for a remote service: pages of the customer table by key.

    It keeps the table in files sorted by key, so that a page costs the files that hold it.
    """
    path = fresh_dir(spark, "served")
    rows = views.table(spark, sf, "customer").select("c_custkey", "c_name").filter("c_custkey IS NOT NULL")
    files = rows.count() // SERVED_ROWS + 1
    rows.repartitionByRange(files, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(path)
    key = F.col("c_custkey")
    written = spark.read.schema(rows.schema).parquet(path).groupBy(F.input_file_name().alias("file"))
    held = written.agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("low").collect()  # one row a file
    names, lows, highs = ([r[c] for r in held] for c in ("file", "low", "high"))

    def fetch(params, body):
        """One page of the customer table, as a remote service would answer it."""
        from bisect import bisect_left

        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        start, size = params["offset"], params["limit"]
        key = ds.field("c_custkey")
        items = []
        for name in names[bisect_left(highs, start) : bisect_left(lows, start + size)]:
            store, file = FileSystem.from_uri(name)
            page = ds.dataset(file, filesystem=store).to_table(filter=(key >= start) & (key < start + size))
            items += page.to_pylist()
        return {"items": items, "meta": {"more": len(items) == size}}

    return fetch


_PAGING = {"mode": "offset", "config": json.dumps({"page_size": 100, "has_more_path": "$.meta.more"})}


@query("a5_paged_source", """
SELECT page_index, c_custkey, c_name FROM (SELECT c_custkey // 100 AS page_index, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer)""")
def a5(spark, sf):
    register_paged_json(spark, "customer_pages", _customer_pages(spark, sf))
    pages = spark.read.format("customer_pages").options(**_PAGING, parallel_pages="8").load()
    kept = paging.cut_tail(cut_lineage(pages), [], F.col("has_more"))  # landed once, so no page is asked for twice
    found = records.extract_json_records(kept, "payload", "$.items", ["page_index"])
    return found.select(
        "page_index", F.get_json_object("record", "$.c_custkey").alias("c_custkey"),
        F.get_json_object("record", "$.c_name").alias("c_name"))


@query("a5d_token_history", """
SELECT c AS custkey, CASE WHEN n > 1 THEN l[n - 1] END AS token, CASE WHEN n > 1 THEN n - 2 END AS left_over,
  CASE WHEN n > 2 THEN l[n - 2] END AS before
FROM (SELECT o_custkey AS c, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY 1)""")
def a5d(spark, sf):
    """Each customer pages through its orders by token; the history is what it saw before the last page."""
    orders = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    tokens = F.transform("l", lambda o: o.cast("string"))
    seen = F.slice(tokens, F.lit(1), F.size("l") - 1)
    history = F.aggregate(seen, F.array().cast("array<string>"), paging.next_history)
    back = orders.select("o_custkey", paging.previous_token(history).alias("b"))
    again = back.select("*", paging.previous_token(F.col("b.history")).alias("bb"))
    return again.select(
        F.col("o_custkey").alias("custkey"), F.col("b.token").alias("token"),
        F.when(F.col("b").isNotNull(), F.size("b.history").cast("long")).alias("left_over"), F.col("bb.token").alias("before"))


# --- upserts ------------------------------------------------------------------------


@query("a8_result_upsert", """
SELECT eval_run_id, row_index, arg_min(id, event_id) AS id, arg_min(ts, event_id) AS created_at,
  arg_max(event_type, event_id) AS actual_output, arg_max(value, event_id) AS score
FROM (SELECT user_id % 20 AS eval_run_id, event_id % 997 AS row_index, 'r' || event_id AS id, * FROM events) GROUP BY ALL""")
def a8(spark, sf):
    writes = views.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("eval_run_id"), (F.col("event_id") % 997).alias("row_index"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("actual_output"), F.col("value").alias("score"), F.col("event_id").alias("arrival"))
    schema = writes.drop("arrival").schema
    store = results_table(fresh_dir(spark, "results"), schema)
    half = writes.agg((F.max("arrival") / 2).cast("long")).first()[0]
    for batch, part in enumerate([writes.filter(F.col("arrival") <= half), writes.filter(F.col("arrival") > half)]):
        store.upsert(part, batch, "arrival")
    store.upsert(writes.filter(F.col("arrival") > half), 1, "arrival")  # a replay changes nothing
    return store.current(spark)


_KNOWN = """known AS (SELECT text, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING min(doc_id) % 3 = 0)"""


def _cache(spark, sf):
    docs = views.table(spark, sf, "documents")
    known = docs.groupBy("text").agg(F.min("doc_id").alias("first_doc")).filter(F.col("first_doc") % 3 == 0)
    return known.select(
        cache_key(F.lit("dutch"), F.col("text")).alias("cache_key"), F.col("text").alias("source_text"),
        F.concat(F.lit("cached:"), "text").alias("translated_text"))


@query("c4_cached_translations", with_ctes(
    "SELECT sha256('dutch' || chr(0) || text) AS cache_key, text AS source_text, 'cached:' || text AS translated_text FROM known", _KNOWN))
def c4(spark, sf):
    unique = translate.unique_texts(views.table(spark, sf, "documents"), ["text"], "Dutch")
    return translate.cached(unique, _cache(spark, sf))


@query("c5_missing_translations", with_ctes(
    """SELECT DISTINCT sha256('dutch' || chr(0) || text) AS cache_key, text AS source_text FROM documents
WHERE text <> '' AND text NOT IN (SELECT text FROM known)""", _KNOWN))
def c5(spark, sf):
    unique = translate.unique_texts(views.table(spark, sf, "documents"), ["text"], "Dutch")
    return translate.missing(unique, _cache(spark, sf))


def stub_translator(instruction: str, request: str) -> str:
    """Prefixes texts; answers a batch with a long text wrongly, so that it is retried one by one."""
    inputs = json.loads(request)["inputs"]
    if len(inputs) > 1 and any(len(t) > 20_000 for t in inputs):
        return '{"translations": ["too few"]}'
    return json.dumps({"translations": [f"translated:{t}" for t in inputs]}, ensure_ascii=False)


_TRANSLATED = """CASE WHEN text = '' THEN '' WHEN text IN (SELECT text FROM known) THEN 'cached:' || text ELSE 'translated:' || text END"""


def _translated(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "text", "source")
    return docs, translate.translate_columns(
        docs, ["text"], " Dutch", stub_translator, spread_by=["doc_id"], cache=_cache(spark, sf))


@query("j6_translate_documents", with_ctes(f"SELECT doc_id, {_TRANSLATED} AS text, source FROM documents", _KNOWN))
def j6(spark, sf):
    return _translated(spark, sf)[1][0]


@query("su3_known_translations", with_ctes(
    """SELECT DISTINCT text AS source_text, CASE WHEN text IN (SELECT text FROM known) THEN 'cached:' ELSE 'translated:' END || text AS translated_text
FROM documents WHERE text <> ''""", _KNOWN))
def su3(spark, sf):
    docs = views.table(spark, sf, "documents")
    unique = translate.unique_texts(docs, ["text"], "Dutch")
    cache = _cache(spark, sf)
    fresh = translate.request_translations(translate.missing(unique, cache), "Dutch", stub_translator)
    return translate.cached(unique, cache).unionByName(fresh).select("source_text", "translated_text")


@query("c11_apply_translations", """
SELECT conv_id, turn, 'en:' || role AS role, 'en:' || text AS text FROM conversations""")
def c11(spark, sf):
    turns = views.table(spark, sf, "conversations")
    unique = translate.unique_texts(turns, ["role", "text"], "English")
    known = unique.select("cache_key", F.concat(F.lit("en:"), "source_text").alias("translated_text"))
    return translate.apply_translations(turns, ["role", "text"], known, "English", ["conv_id", "turn"])


@query("su5_changed_rows", """
SELECT doc_id, true AS changed, 'text' AS changed_fields FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, false, '' FROM documents WHERE text = ''""")
def su5(spark, sf):
    docs, (translated, _) = _translated(spark, sf)
    return compare.changed_fields(docs, translated, ["doc_id"], ["text", "source"])


@query("s11_parse_replies", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'a|' || user_id WHEN 'purchase' THEN NULL END AS texts FROM events""")
def s11(spark, sf):
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    good = F.concat(F.lit('{"translations": ["a", "'), user, F.lit('"]}'))
    reply = (
        F.when(kind == "view", good)
        .when(kind == "purchase", F.concat(F.lit('{"translations": ["a", '), user, F.lit("]}")))
        .when(kind == "click", '{"translations": ["a"]}')
        .when(kind == "error", "no json")
        .otherwise('{"other": []}'))
    return views.table(spark, sf, "events").select(
        "event_id", F.array_join(translate.parse_reply(reply, F.lit(2)), "|").alias("texts"))


@query("k4_cache_upsert", """
SELECT sha256('dutch' || chr(0) || text) AS cache_key, text AS source_text,
  CASE WHEN min(doc_id) % 2 = 0 THEN 'v2:' ELSE 'v1:' END || text AS translated_text,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM documents GROUP BY text""")
def k4(spark, sf):
    docs = views.table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    entries = docs.select(
        "doc_id", cache_key(F.lit("dutch"), F.col("text")).alias("cache_key"), F.col("text").alias("source_text"))

    def version(number, rows):
        fresh = rows.withColumn("translated_text", F.concat(F.lit(f"v{number}:"), "source_text"))
        return translate.cache_rows(fresh, "Dutch", F.lit(f"2024-01-0{number} 00:00:00").cast("timestamp_ntz"))

    first = version(1, entries)
    store = translation_cache(fresh_dir(spark, "cache"), first.schema)
    store.upsert(first, 0)
    store.upsert(version(2, entries.filter(F.col("doc_id") % 2 == 0)), 1)
    return store.current(spark).select("cache_key", "source_text", "translated_text", "created_at")


# --- discovery ------------------------------------------------------------------------


def _record_texts(spark, sf):
    return views.records(spark, sf).select(F.to_json("record").alias("text"))


_TREE = _ITEMS + """,
tree AS (SELECT DISTINCT regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS path, t.type FROM (
    SELECT json_object('id', l_orderkey, 'line', l_linenumber, 'status', l_linestatus, 'open', l_linestatus = 'O', 'items', items,
      'meta', [{'key': 'priority', 'value': 'p' || l_linenumber}], 'shipping', {'price': l_extendedprice, 'rate': l_tax}) AS j FROM items) x,
  json_tree(x.j) t)"""


@query("d10_array_paths", with_ctes("SELECT DISTINCT path FROM tree WHERE type = 'ARRAY'", _TREE))
def d10(spark, sf):
    return discover.array_paths(_record_texts(spark, sf), "text")


@query("d11_field_paths", with_ctes("SELECT DISTINCT substr(path, 3) AS path FROM tree WHERE type <> 'OBJECT'", _TREE))
def d11(spark, sf):
    return discover.field_paths(_record_texts(spark, sf), "text")


# Orders by customer as one list, and one more element whose paths no other has: at the end of long lists.
_LONG = """
WITH lists AS (SELECT o_custkey AS k, list(json_object('order', o_orderkey) ORDER BY o_orderkey) AS l FROM orders GROUP BY 1),
payload AS (SELECT json_object('rows', list_append(l, json_object('late', [json_object('n', len(l))]))) AS j FROM lists),
tree AS (SELECT DISTINCT regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g') AS path, t.type FROM payload p, json_tree(p.j) t)"""


def _long_lists(spark, sf):
    orders = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    plain = F.transform("l", lambda o: F.concat(F.lit('{"order": '), o.cast("string"), F.lit("}")))
    last = F.concat(F.lit('{"late": [{"n": '), F.size("l").cast("string"), F.lit("}]}"))
    return orders.select(F.concat(F.lit('{"rows": ['), F.array_join(F.array_append(plain, last), ", "), F.lit("]}")).alias("text"))


@query("d10_long_lists", _LONG + "SELECT DISTINCT path FROM tree WHERE type = 'ARRAY'")
def d10_long(spark, sf):
    return discover.array_paths(_long_lists(spark, sf), "text")


@query("d11_long_lists", _LONG + "SELECT DISTINCT substr(path, 3) AS path FROM tree WHERE type <> 'OBJECT'")
def d11_long(spark, sf):
    return discover.field_paths(_long_lists(spark, sf), "text")


# --- streams over the given tables -------------------------------------------------------


def _event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


INBOX_ROWS = 1_000_000  # rows of a file of the late events


def _late_event_stream(spark, sf):
    """All events in five parts, one for each trigger: rows up to five days late, the first part twice.

    A part is as many files as its rows need, the same number for all parts.
    """
    inbox, events = fresh_dir(spark, "inbox"), views.table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    first, last, rows = events.agg(F.min(seconds), F.max(seconds), F.count(F.lit(1))).first()
    late = F.pmod(F.xxhash64("event_id"), F.lit(5 * 86_400))
    part = F.floor((seconds + late - first) * 4 / (last - first + 5 * 86_400 + 1))
    files = rows // (4 * INBOX_ROWS) + 1
    for i in (0, 1, 2, 3, 0):
        mine = events.filter(part == i)
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.mode("append").parquet(inbox)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(inbox)


def _stream_store(spark, sf):
    """Outputs arrive as a stream, are graded and upserted (each row of the run once)."""
    kind = F.col("event_type")
    outputs = _event_stream(spark, sf).select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
        (F.col("user_id") % 20).alias("eval_run_id"), F.col("event_id").alias("row_index"),
        F.col("ts").alias("created_at"), F.when(F.col("value") >= 50, "purchase").otherwise("view").alias("expected_output"),
        F.when(kind != "error", kind).alias("actual_output"), F.when(kind == "error", "API error").alias("error"))
    definitions = [
        {"type": "exact_match", "name": "same"},
        {"type": "pattern_match", "name": "kind", "pattern": "^(view|click)$", "weight": 0.5, "threshold": None},
    ]

    def grade(batch):
        graders = grading.build_graders(definitions, grading.Context())
        return grading.grade(batch, graders).drop("details")

    schema = grade(outputs).schema
    table = results_table(fresh_dir(spark, "stream"), schema)
    grade_stream.start_grading(outputs, grade, table, fresh_dir(spark, "checkpoint"), order="created_at").awaitTermination()
    return table


_STREAMED = """graded AS (SELECT user_id % 20 AS eval_run_id, event_id AS row_index,
  CASE WHEN event_type = 'error' THEN 'API error' END AS error,
  CASE WHEN event_type <> 'error' THEN (CASE WHEN event_type = CASE WHEN value >= 50 THEN 'purchase' ELSE 'view' END THEN 1.0 ELSE 0.0 END
    + 0.5 * CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END) / 1.5::DOUBLE END AS score,
  CASE WHEN event_type <> 'error' THEN event_type = CASE WHEN value >= 50 THEN 'purchase' ELSE 'view' END END AS passed FROM events)"""


@query("t1_stream_grading", with_ctes(
    "SELECT eval_run_id, row_index, error, score, passed FROM graded", _STREAMED))
def t1(spark, sf):
    return _stream_store(spark, sf).current(spark).select("eval_run_id", "row_index", "error", "score", "passed")


@query("t2_run_progress", """
SELECT user_id % 20 AS eval_run_id, count(*) AS progress, count(*) AS total_rows, CAST(100 AS BIGINT) AS percent FROM events GROUP BY 1""")
def t2(spark, sf):
    path = fresh_dir(spark, "progress")
    running.start_progress(spark, _stream_store(spark, sf), path, fresh_dir(spark, "checkpoint")).awaitTermination()
    totals = views.results(spark, sf).groupBy("eval_run_id").agg(F.count(F.lit(1)).alias("total_rows"))
    return grade_stream.progress_view(running.latest_progress(spark, path), totals)


# A run fails when its deadline and the longest delay of a heartbeat (two hours) have passed.
_SILENT = """
SELECT eval_run_id, 'failed' AS status, last_heartbeat, last_heartbeat + INTERVAL 30 MINUTE AS failed_at
FROM (SELECT user_id AS eval_run_id, min(ts) AS last_heartbeat
  FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
  WHERE following > ts + INTERVAL 30 MINUTE OR following IS NULL GROUP BY user_id)
WHERE last_heartbeat + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {late} FROM events)"""


def _silent_runs(spark, events, watermark):
    beats = events.select(F.col("user_id").alias("eval_run_id"), "ts", F.lit(False).alias("ended"))
    target = fresh_dir(spark, "silent")
    silent = heartbeat.failed_runs(beats, watermark=watermark)
    silent.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", fresh_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    failed = spark.read.schema(silent.schema).parquet(target)
    return failed.select(
        "eval_run_id", "status", F.col("last_heartbeat").cast("timestamp_ntz").alias("last_heartbeat"),
        F.col("failed_at").cast("timestamp_ntz").alias("failed_at"))


@query("t3_silent_runs", _SILENT.format(late="2 HOUR"))
def t3(spark, sf):
    return _silent_runs(spark, _event_stream(spark, sf), "2 hours")


@query("t3_late_heartbeats", _SILENT.format(late="6 DAY"))
def t3_late(spark, sf):
    return _silent_runs(spark, _late_event_stream(spark, sf), "6 days")


@query("t4_paged_import", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def t4(spark, sf):
    register_paged_json(spark, "customer_feed", _customer_pages(spark, sf))
    target = fresh_dir(spark, "import")

    def to_rows(pages):
        found = records.extract_json_records(pages, "payload", "$.items", [])
        return found.select(
            F.get_json_object("record", "$.c_custkey").alias("c_custkey"),
            F.get_json_object("record", "$.c_name").alias("c_name"))

    options = {**_PAGING, "records_path": "$.items"}
    importing = paged_stream.start_import(
        spark, "customer_feed", options, to_rows, target, fresh_dir(spark, "checkpoint"), interval="0 seconds")
    try:
        importing.processAllAvailable()
    finally:
        importing.stop()
    return spark.read.schema("c_custkey string, c_name string").parquet(target).drop("batch")


def _streamed_summary(spark, sf, events):
    stream = views.shape_results(events).withColumn("row_index", F.col("event_id"))
    target = fresh_dir(spark, "summary")
    running.start_summary(stream, target, fresh_dir(spark, "checkpoint"), order="created_at").awaitTermination()
    return running.latest_summary(spark, target)


@query("t5_stream_summary", with_ctes(_SUMMARY, SQL_RESULTS))
def t5(spark, sf):
    return _streamed_summary(spark, sf, _event_stream(spark, sf))


@query("t5_late_results", with_ctes(_SUMMARY, SQL_RESULTS))
def t5_late(spark, sf):
    return _streamed_summary(spark, sf, _late_event_stream(spark, sf))
