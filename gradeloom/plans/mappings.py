"""Queries over records, the mapping language, paging rules and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions.mapping import infer_record_type, json_record, map_records, typed_record
from gradeloom.plans import views
from gradeloom.plans.registry import query
from gradeloom.sources import paging, records

# Each check builds the three items of a record the way the view does.
_ITEMS = """items AS (SELECT *, row_number() OVER () AS rid,
  [{'partkey': l_partkey, 'qty': l_quantity, 'flag': l_returnflag, 'status': l_linestatus},
   {'partkey': l_suppkey, 'qty': 51.0::DOUBLE - l_quantity, 'flag': l_linestatus, 'status': l_returnflag},
   {'partkey': l_partkey + 1, 'qty': 10.0::DOUBLE, 'flag': 'N', 'status': l_linestatus}][1:(l_linenumber % 3) + 1] AS items
  FROM lineitem)"""


def _sql(body: str) -> str:
    return f"WITH {_ITEMS}\nSELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS line, {body} FROM items"


def _mapped(spark, sf, **mapping):
    df = views.records(spark, sf)
    return map_records(df, typed_record(df, "record"), {"id": "id", "line": "$.line", **mapping})


@query("m1_map_records", _sql("""'Order ' || l_orderkey || ': ' || items[1].partkey AS input, l_linestatus AS expected_output,
  '' AS missing, 'p' || l_linenumber AS priority"""))
def m1(spark, sf):
    return _mapped(spark, sf, input="Order {id}: {items[0].partkey}", expected_output="status",
                   missing="no.such.field", priority="meta[0].value")


@query("m2_paths", _sql("""CAST(l_extendedprice AS VARCHAR) AS price, coalesce(CAST(items[3].partkey AS VARCHAR), '') AS third,
  '' AS on_list, '' AS on_text, coalesce(items[2].flag, '') AS second"""))
def m2(spark, sf):
    return _mapped(spark, sf, price="$.shipping.price", third="$.items[2].partkey", on_list="items.partkey",
                   on_text="status.x[0]", second="items[1].flag")


@query("m3_wildcards", _sql("""'[' || array_to_string(list_transform(items, lambda x: CAST(x.qty AS VARCHAR)), ',') || ']' AS quantities,
  '["' || array_to_string(list_transform(items, lambda x: x.flag), '","') || '"]' AS flags, '[]' AS nothing, '' AS no_list"""))
def m3(spark, sf):
    return _mapped(spark, sf, quantities="items[].qty", flags="$.items[].flag", nothing="items[].none", no_list="status[]")


@query("m4_templates", _sql("""'a' || l_linestatus || 'b' || l_linenumber || '{}' AS two, '' AS empty, 'plain ' AS plain_path,
  l_linestatus || l_linestatus AS twice"""))
def m4(spark, sf):
    return _mapped(spark, sf, two="a{status}b{ line }{}", empty="", plain_path="plain {nope}", twice="{status}{$.status}")


@query("m5_text_forms", _sql("""CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END AS flag, CAST(l_tax AS VARCHAR) AS rate,
  '{"partkey":' || items[1].partkey || ',"qty":' || CAST(items[1].qty AS VARCHAR) || ',"flag":"' || items[1].flag || '","status":"' || items[1].status || '"}' AS object,
  '' AS nothing"""))
def m5(spark, sf):
    return _mapped(spark, sf, flag="open", rate="shipping.rate", object="items[0]", nothing="null")


@query("m6_ternaries", _sql("""CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'open' END AS state,
  CASE WHEN l_linenumber = 1 THEN 'first' WHEN l_linenumber = 2 THEN 'second' ELSE CAST(l_orderkey AS VARCHAR) END AS rank"""))
def m6(spark, sf):
    return _mapped(spark, sf, state='{status == "F" ? "done" : "open"}',
                   rank='line == 1 ? "first" : line = 2 ? "second" : id')


@query("m7_comparisons", _sql("""CASE WHEN l_linenumber = 3 THEN 'y' ELSE 'n' END AS text_number,
  CASE WHEN l_extendedprice >= 50000 THEN 'y' ELSE 'n' END AS number_text, CASE WHEN l_linestatus > 'G' THEN 'y' ELSE 'n' END AS words,
  'n' AS mixed, CASE WHEN l_linestatus = 'O' THEN 'y' ELSE 'n' END AS bool_number, 'n' AS bool_order, 'y' AS nulls,
  CASE WHEN l_linestatus <> 'O' THEN 'y' ELSE 'n' END AS differs"""))
def m7(spark, sf):
    def ask(test):
        return f'{{{test} ? "y" : "n"}}'

    return _mapped(spark, sf, text_number=ask('"3" = line'), number_text=ask("meta[1].value >= 50000"),
                   words=ask('status > "G"'), mixed=ask("status < 5"), bool_number=ask("open == 1"),
                   bool_order=ask("open >= 0"), nulls=ask("none == null"), differs=ask('status != "O"'))


@query("m8_list_equality", _sql("""CASE WHEN len(list_filter(items, lambda x: x.flag = 'R')) > 0 THEN 'returned' ELSE 'kept' END AS any_item,
  CASE WHEN len(list_filter(items, lambda x: x.flag = 'R')) = 0 THEN 'kept' ELSE 'returned' END AS no_item,
  CASE WHEN list_transform(items, lambda x: x.flag) = list_transform(items, lambda x: x.status) THEN 'same' ELSE 'other' END AS lists"""))
def m8(spark, sf):
    return _mapped(spark, sf, any_item='{items[].flag = "R" ? "returned" : "kept"}',
                   no_item='{items[].flag != "R" ? "kept" : "returned"}',
                   lists='{items[].flag == items[].status ? "same" : "other"}')


@query("m9_list_order", _sql("""CASE WHEN len(list_filter(items, lambda x: x.qty > 45)) > 0 THEN 'bulk' ELSE 'small' END AS size,
  CASE WHEN len(list_filter(items, lambda x: x.qty <= l_linenumber)) > 0 THEN 'low' ELSE 'high' END AS rel, 'no' AS kinds"""))
def m9(spark, sf):
    return _mapped(spark, sf, size='{items[].qty > 45 ? "bulk" : "small"}', rel='{line >= items[].qty ? "low" : "high"}',
                   kinds='{items[].flag > 1 ? "yes" : "no"}')


@query("m10_truth", _sql("""CASE WHEN l_linestatus = 'O' THEN 'y' ELSE 'n' END AS flag, CASE WHEN l_tax <> 0 THEN 'y' ELSE 'n' END AS number,
  'y' AS list, 'n' AS missing, 'n' AS empty_list, 'y' AS word"""))
def m10(spark, sf):
    def ask(test):
        return f'{{{test} ? "y" : "n"}}'

    return _mapped(spark, sf, flag=ask("open"), number=ask("shipping.rate"), list=ask("items"), missing=ask("none"),
                   empty_list=ask("items[].none"), word=ask('"false "'))


@query("m11_parse_json", """
SELECT event_id, json_extract_string(props, '$.k') AS k, '' AS missing, '' AS invalid,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'high' ELSE 'low' END AS level,
  replace(props, ' ', '') AS whole FROM events""")
def m11(spark, sf):
    events = views.table(spark, sf, "events").select("event_id", F.struct("event_type", "props").alias("record"))
    mapping = {"k": "parse_json(props).k", "missing": "parse_json(props).none", "invalid": "parse_json(event_type).k",
               "level": '{parse_json(props).k > 50 ? "high" : "low"}', "whole": "parse_json(props)"}
    return map_records(events, typed_record(events, "record"), mapping, keep=["event_id"])


@query("m12_find", _sql("""'p' || l_linenumber AS priority, '' AS none,
  CAST(CAST(l_shipdate AS TIMESTAMP) AS VARCHAR) AS ship, 'tag p' || l_linenumber || '!' AS templated"""))
def m12(spark, sf):
    return _mapped(spark, sf, priority='find(meta, key == "priority").value', none='find(meta, key == "other").value',
                   ship='parse_json(find(meta, key = "context").value).ship',
                   templated='tag {find(meta, key == "priority").value}!')


@query("m13_function_calls", _sql("""'' AS unknown, '' AS too_few, 'p' || l_linenumber AS spaced, CAST(l_linenumber AS VARCHAR) AS chained"""))
def m13(spark, sf):
    return _mapped(spark, sf, unknown="upper(status)", too_few="find(meta)", spaced='find( meta , key == "priority" ).value',
                   chained='parse_json(find(meta, key == "context").value).line')


@query("m14_literals", _sql("""'a, b' AS quoted, 'True' AS yes, '' AS nothing, '-12' AS whole, '0.5' AS part, 'x?y:z' AS marks"""))
def m14(spark, sf):
    return _mapped(spark, sf, quoted='"a, b"', yes="true", nothing="null", whole="-12", part="0.50", marks="'x?y:z'")


_INFERRED = """SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS line,
  l_linestatus AS status, CAST(l_extendedprice AS VARCHAR) AS price FROM lineitem"""


@query("m1_json_records_inferred", _INFERRED)
def m1_inferred(spark, sf):
    texts = views.records(spark, sf).select(F.to_json("record").alias("payload"))
    record = json_record("payload", infer_record_type(texts, "payload"))
    return map_records(texts, record, {"id": "id", "line": "line", "status": "status", "price": "shipping.price"})


# --- records of payloads -------------------------------------------------------------


def _payloads(spark, sf):
    """Payload text per line item; every seventh has no list."""
    df = views.records(spark, sf)
    data = F.struct(F.when(F.col("record.line") != 7, F.col("record.items")).alias("items"))
    return df.select(
        F.col("record.id").alias("id"), F.col("record.line").alias("line"),
        F.to_json(F.struct(data.alias("data"))).alias("payload"))


_PAYLOAD_DDL = "struct<data:struct<items:array<struct<partkey:bigint,qty:double,flag:string,status:string>>>>"


@query("a4_extract_records", f"""WITH {_ITEMS}
SELECT l_orderkey AS id, l_linenumber AS line, CAST(i - 1 AS INTEGER) AS record_index, items[i].partkey AS partkey, items[i].flag AS flag
FROM items, (SELECT unnest([1, 2, 3]) AS i) WHERE l_linenumber <> 7 AND i <= len(items)""")
def a4(spark, sf):
    df = _payloads(spark, sf)
    out = records.extract_records(df, json_record("payload", _PAYLOAD_DDL), "$.data.items", ["id", "line"])
    return out.select("id", "line", "record_index", "record.partkey", "record.flag")


@query("a4_extract_wildcard", f"""WITH {_ITEMS}
SELECT l_orderkey AS id, l_linenumber AS line, CAST(i - 1 AS INTEGER) AS record_index, items[i].flag AS record
FROM items, (SELECT unnest([1, 2, 3]) AS i) WHERE l_linenumber <> 7 AND i <= len(items)""")
def a4_wildcard(spark, sf):
    df = _payloads(spark, sf)
    return records.extract_records(df, json_record("payload", _PAYLOAD_DDL), "$.data.items[].flag", ["id", "line"])


@query("a4_extract_untyped", f"""WITH {_ITEMS}
SELECT l_orderkey AS id, l_linenumber AS line, CAST(i - 1 AS INTEGER) AS record_index, CAST(items[i].partkey AS VARCHAR) AS partkey
FROM items, (SELECT unnest([1, 2, 3]) AS i) WHERE l_linenumber <> 7 AND i <= len(items)""")
def a4_untyped(spark, sf):
    out = records.extract_json_records(_payloads(spark, sf), "payload", "$.data.items", ["id", "line"])
    return out.select("id", "line", "record_index", F.get_json_object("record", "$.partkey").alias("partkey"))


@query("a9_append_from_source", f"""WITH {_ITEMS}
SELECT p_name AS input, p_brand AS expected_output, '' AS note FROM part
UNION ALL SELECT 'Order ' || l_orderkey, l_linestatus, '' FROM items""")
def a9(spark, sf):
    old = views.table(spark, sf, "part").select(F.col("p_name").alias("input"), F.col("p_brand").alias("expected_output"))
    snapshot = records.import_snapshot("s1", "$.items", {"input": "Order {id}", "expected_output": "status"})
    new = views.records(spark, sf)
    return records.append_from_source(
        old, ["input", "expected_output", "note"], snapshot, new, typed_record(new, "record"))


@query("a11_import_rows", f"""WITH {_ITEMS}
SELECT CAST(l_linenumber AS VARCHAR) AS input, l_returnflag AS expected_output FROM items""")
def a11(spark, sf):
    df = views.records(spark, sf)
    snapshot = records.import_snapshot("s1", "$", {"input": "line", "expected_output": "items[0].flag"})
    return records.import_rows(df, typed_record(df, "record"), snapshot)


@query("a12_ready_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS input, CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END AS expected_output,
  CAST(c_acctbal AS VARCHAR) AS balance, CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS debt FROM customer""")
def a12(spark, sf):
    df = views.table(spark, sf, "customer").select(
        (F.col("c_acctbal") < 0).alias("debt"), F.col("c_acctbal").alias("balance"),
        F.col("c_custkey").alias("input"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("expected_output"))
    return records.ready_rows(df, ["input", "expected_output", "balance", "debt"])


@query("a13_explore_settings", """
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN '$.own' WHEN s_suppkey IS NOT NULL THEN '$.' || s_name END AS records_path,
  CASE WHEN p_size % 3 = 0 THEN p_name ELSE s_name END AS input
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def a13(spark, sf):
    size = F.col("p_size")
    requests = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 150).alias("preset_id"),
        F.when(size % 2 == 0, "$.own").alias("records_path"),
        F.when(size % 3 == 0, F.create_map(F.lit("input"), F.col("p_name"))).alias("field_mapping"))
    presets = views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("$."), "s_name").alias("records_path"),
        F.create_map(F.lit("input"), F.col("s_name")).alias("field_mapping"))
    return records.explore_settings(requests, presets).select(
        "id", "records_path", F.col("field_mapping")["input"].alias("input"))


@query("a11_import_settings", """
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN s_suppkey IS NOT NULL THEN 'n' || s_nationkey END AS data_source_id,
  CASE WHEN p_size % 4 = 0 THEN '$.own' WHEN s_suppkey IS NOT NULL THEN '$.' || s_name END AS records_path,
  CASE WHEN p_size % 4 = 0 THEN p_name WHEN s_suppkey IS NOT NULL THEN s_name END AS input
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 150""")
def a11_settings(spark, sf):
    own = F.col("p_size") % 4 == 0
    requests = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(~own, F.col("p_partkey") % 150).alias("preset_id"),
        F.col("p_brand").alias("data_source_id"), F.lit("$.own").alias("records_path"),
        F.create_map(F.lit("input"), F.col("p_name")).alias("field_mapping"))
    presets = views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("data_source_id"),
        F.concat(F.lit("$."), "s_name").alias("records_path"), F.create_map(F.lit("input"), F.col("s_name")).alias("field_mapping"))
    return records.import_settings(requests, presets).select(
        "id", "data_source_id", "records_path", F.col("field_mapping")["input"].alias("input"))


# --- paging ------------------------------------------------------------------------------


def _sources(spark, sf):
    """Customers as paged sources: mode, configuration, state, override."""
    key = F.col("c_custkey")
    mode = F.get(F.array(*[F.lit(m) for m in paging.MODES]), (key % 4).cast("int"))
    # map keys with a NULL value stand for options that are not set
    config = F.create_map(
        F.lit("start_page"), F.when(key % 3 == 0, "2"), F.lit("start_offset"), F.when(key % 3 == 1, "abc"),
        F.lit("page_size"), F.when(key % 5 == 0, " 20 "), F.lit("page_size_param"), F.when(key % 2 == 0, "per_page").otherwise("size"),
        F.lit("placement"), F.when(key % 7 == 0, "body"), F.lit("initial_token"), F.when(key % 3 == 2, "t0"),
        F.lit("offset_param"), F.when(key % 11 == 0, "skip"))
    none = F.lit(None).cast("string")
    state = F.when(key % 8 >= 4, F.create_map(
        F.lit("page"), F.when(key % 9 != 0, (key % 6).cast("string")), F.lit("offset"), (key % 100).cast("string"),
        F.lit("token"), F.when(key % 2 == 0, F.concat(F.lit("t"), key.cast("string"))).otherwise(none)))
    return views.table(spark, sf, "customer").select(
        key.alias("id"), mode.alias("mode"), config.alias("config"), state.alias("state"),
        F.when(key % 13 == 0, 7).alias("override"),
        F.when(key % 14 == 0, F.concat(F.lit('{"q":"'), "c_mktsegment", F.lit('"}'))).alias("body"))


_SOURCES = f"""sources AS (SELECT c_custkey AS id, {list(paging.MODES)!r}[c_custkey % 4 + 1] AS mode, c_custkey AS k, c_mktsegment AS seg,
  c_custkey % 8 >= 4 AS st FROM customer),
placed AS (SELECT *,
  CASE WHEN mode = 'page' THEN CASE WHEN st AND k % 9 <> 0 THEN k % 6 WHEN k % 3 = 0 THEN 2 ELSE 1 END
       WHEN mode = 'offset' THEN CASE WHEN st THEN k % 100 ELSE 0 END END AS position,
  CASE WHEN mode = 'next_token' THEN CASE WHEN st THEN CASE WHEN k % 2 = 0 THEN 't' || k END WHEN k % 3 = 2 THEN 't0' END END AS token,
  CASE WHEN k % 13 = 0 THEN 7 WHEN k % 5 = 0 THEN 20 WHEN mode = 'offset' THEN 50 END AS size,
  CASE mode WHEN 'page' THEN CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END WHEN 'offset' THEN 0 END AS start FROM sources)"""


def _placed(spark, sf):
    df = _sources(spark, sf)
    mode, config, state = F.col("mode"), F.col("config"), F.col("state")
    none = F.create_map().cast("map<string,string>")
    return df.select(
        "*", paging.start_position(mode, config, state).alias("position"),
        paging.start_token(mode, config, state).alias("token"),
        paging.page_size(mode, config, F.col("override")).alias("size"),
        paging.start_position(mode, config, none).alias("start"))


@query("a5a_start_states", f"WITH {_SOURCES} SELECT id, mode, position, token FROM placed")
def a5a(spark, sf):
    return _placed(spark, sf).select("id", "mode", "position", "token")


@query("a5a_planned_pages", f"""WITH {_SOURCES}
SELECT id, CAST(i AS BIGINT) AS page_index, position + i * CASE WHEN mode = 'page' THEN 1 ELSE size END AS position
FROM placed, (SELECT unnest(range(0, 9)) AS i) WHERE mode IN ('page', 'offset') AND i < k % 10""")
def a5a_pages(spark, sf):
    df = _placed(spark, sf).filter(F.col("mode").isin("page", "offset")).withColumn(
        "step", F.when(F.col("mode") == "page", F.lit(1).cast("long")).otherwise(F.col("size"))
    ).withColumn("pages", F.col("id") % 10).withColumnRenamed("position", "first")
    return paging.planned_pages(df, "first", "step", "pages").select("id", "page_index", "position")


@query("a5b_request_values", f"""WITH {_SOURCES}
SELECT id, CASE WHEN k % 7 = 0 AND k % 14 = 0 THEN 'body' ELSE 'query' END AS placement,
  CASE WHEN mode = 'page' THEN CAST(position AS VARCHAR) END AS page,
  CASE WHEN mode = 'page' AND k % 2 = 0 THEN CAST(size AS VARCHAR) END AS per_page,
  CASE WHEN mode = 'page' AND k % 2 <> 0 THEN CAST(size AS VARCHAR) END AS size,
  CASE WHEN mode = 'offset' AND k % 11 = 0 THEN CAST(position AS VARCHAR) END AS skip,
  CASE WHEN mode = 'offset' AND k % 11 <> 0 THEN CAST(position AS VARCHAR) END AS "offset",
  CASE WHEN mode = 'offset' THEN CAST(size AS VARCHAR) END AS "limit",
  CASE WHEN mode = 'next_token' THEN token END AS page_token, CASE WHEN k % 14 = 0 THEN seg END AS q FROM placed""")
def a5b(spark, sf):
    df = _placed(spark, sf)
    values = paging.request_values(F.col("mode"), F.col("config"), F.col("position"), F.col("token"), F.col("size"))
    df = df.withColumn("values", values)
    params, body = paging.with_request(
        F.create_map().cast("map<string,string>"), F.col("body"), F.col("config"), F.col("values"))
    df = df.withColumn("params", params).withColumn("fields", body)
    names = ["page", "per_page", "size", "skip", "offset", "limit", "page_token"]
    return df.select(
        "id", paging.placement(F.col("config"), F.col("body")).alias("placement"),
        *[F.coalesce(F.col("params")[n], F.col("fields")[n]).alias(n) for n in names],
        F.col("fields")["q"].alias("q"))


@query("a5c_next_pages", f"""WITH {_SOURCES}
SELECT id, CASE WHEN more THEN position + CASE mode WHEN 'page' THEN 1 WHEN 'offset' THEN size END END AS next_position,
  CASE WHEN mode = 'next_token' THEN nullif(CASE WHEN k % 6 = 0 THEN '' ELSE seg END, '') END AS next_token
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN k % 2 = 0 ELSE k % 4 > 1 OR k % 10 = 0 END AS more FROM placed)""")
def a5c(spark, sf):
    key = F.col("id")
    flag = F.when(key % 3 == 0, key % 2 == 0)
    more = paging.has_more(flag, F.when(key % 4 > 1, 5).otherwise(0), key % 10 == 0)
    df = _placed(spark, sf).join(
        views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    landed = F.when(key % 6 == 0, "").otherwise(F.col("c_mktsegment"))
    return df.select(
        "id", paging.next_position(F.col("mode"), F.col("position"), F.col("size"), more).alias("next_position"),
        F.when(F.col("mode") == "next_token", paging.next_token(landed)).alias("next_token"))


@query("a5c_cut_tail", """
SELECT o_custkey, page_index, o_orderkey FROM (SELECT o_custkey, o_orderkey // 100 AS page_index, o_orderkey,
  min(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey // 100 END) OVER (PARTITION BY o_custkey) AS last FROM orders)
WHERE last IS NULL OR page_index <= last""")
def a5c_tail(spark, sf):
    pages = views.table(spark, sf, "orders").select(
        "o_custkey", F.floor(F.col("o_orderkey") / 100).alias("page_index"), "o_orderkey", "o_orderpriority")
    return paging.cut_tail(pages, ["o_custkey"], F.col("o_orderpriority") != "5-LOW").select(
        "o_custkey", "page_index", "o_orderkey")


@query("a5d_previous_pages", f"""WITH {_SOURCES}
SELECT id, CASE WHEN position > start THEN CASE mode WHEN 'page' THEN position - 1 WHEN 'offset' THEN greatest(start, position - size) END END AS previous_position
FROM placed""")
def a5d(spark, sf):
    return _placed(spark, sf).select("id", paging.previous_position(
        F.col("mode"), F.col("position"), F.col("start"), F.col("size")).alias("previous_position"))


@query("a2_dataset_profile", """
SELECT count(*) AS row_count, (SELECT array_to_string(list(column_name ORDER BY ordinal_position), ',') FROM (
    SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name, unnest(range(6)) AS ordinal_position)) AS columns,
  (SELECT array_to_string(list(p_name ORDER BY p_partkey), ',') FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 5)) AS preview
FROM part""")
def a2(spark, sf):
    from gradeloom.sources.csv_dataset import profile

    return profile(views.table(spark, sf, "part"), "p_partkey").select(
        "row_count", F.array_join("columns", ",").alias("columns"),
        F.array_join(F.transform("preview", lambda r: r["p_name"]), ",").alias("preview"))
