from __future__ import annotations

import csv
import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gradeloom.operators import discover, graders, translate
from gradeloom.sources import csv_dataset, exports, paging, split_csv
from gradeloom.sources.keyed_table import KeyedTable
from gradeloom.sources.paged_json import Pager, register_paged_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CSV_TEXT = 'input,expected_output,note\n"say ""hi""",yes,plain\n"two\nlines",,""\n\nshort,row\nlong,row,x,surplus\n  pad ,é,"a,b"\n'


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(CSV_TEXT, encoding="utf-8")
    df = csv_dataset.check_dataset(csv_dataset.read_dataset(spark, str(path)))
    assert df.columns == ["input", "expected_output", "note"]
    assert [tuple(r) for r in df.collect()] == [
        ('say "hi"', "yes", "plain"), ("two\nlines", "", ""), ("short", "row", ""), ("long", "row", "x"), ("  pad ", "é", "a,b")]


def split_bytes(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.mark.parametrize(("size", "broadcast_splits"), [(23, 10**6), (61, 0), (1000, 10**6), (1 << 20, 0)])
def test_csv_files_in_splits(spark, tmp_path, small_splits, size, broadcast_splits):
    rng = random.Random(size)
    bits = ["a", "b c", ",", "\n", '"', "\r\n", "\n\n", "é", "", '5" disk', "x" * 20]
    cells = [["".join(rng.choice(bits) for _ in range(rng.randrange(5))) for _ in range(3)] for _ in range(80)]
    want = [(a, b, f"{i} {c}") for i, (a, b, c) in enumerate(cells)]
    for name, ending, rows in (("one", "\n", want[:50]), ("two", "\r\n", want[50:])):
        with open(tmp_path / f"{name}.csv", "w", encoding="utf-8", newline="") as f:
            writer = csv.writer(f, lineterminator=ending)
            writer.writerow(["input", "expected_output", "n"])
            writer.writerows(rows)
    odd = CSV_TEXT.replace("note", "n", 1) + 'un"quoted,"clo""sed",5" disk\nlast,"open\nrow'
    (tmp_path / "three.csv").write_text(odd, encoding="utf-8")
    want += [tuple(r) for r in csv_dataset.read_dataset(spark, str(tmp_path / "three.csv")).collect()]
    split_bytes(spark, size)
    got = split_csv.read_split_dataset(spark, str(tmp_path), broadcast_splits=broadcast_splits)
    assert got.columns == ["input", "expected_output", "n"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_required_columns(spark):
    with pytest.raises(ValueError, match="expected_output"):
        csv_dataset.check_dataset(spark.createDataFrame([("a",)], "input string"))


def test_csv_round_trip(spark, tmp_path):
    rows = [('q "1"', "line\nbreak", " x "), ("", None, "é,;"), ("back\\slash", "tab\t", "'")]
    df = spark.createDataFrame(rows, "input string, expected_output string, z string")
    path = str(tmp_path / "out")
    assert csv_dataset.overwrite_rows(df, path, ["z", "input", "expected_output", "more"]) == 3
    back = csv_dataset.read_dataset(spark, path)
    assert back.columns == ["z", "input", "expected_output", "more"]
    assert sorted(tuple(r) for r in back.collect()) == sorted((z, i, e or "", "") for i, e, z in rows)
    with pytest.raises(ValueError):
        csv_dataset.overwrite_rows(df, path, ["z"])


def test_profile(spark):
    df = spark.range(20).select(F.col("id").alias("n"), (F.col("id") * 2).cast("string").alias("input"))
    got = csv_dataset.profile(df, "n").first()
    assert (got["row_count"], got["columns"]) == (20, ["n", "input"])
    assert [r["n"] for r in got["preview"]] == [0, 1, 2, 3, 4]


# --- keyed table -------------------------------------------------------------------


def batch(spark, rows):
    return spark.createDataFrame(rows, "eval_run_id string, row_index int, id string, actual_output string, at int")


def test_upserts(spark, tmp_path):
    first = batch(spark, [("r", 0, "a", "one", 1), ("r", 1, "b", "two", 2), ("r", 0, "c", "again", 3)])
    second = batch(spark, [("r", 1, "d", None, 1), ("s", 0, "e", "new", 2)])
    table = KeyedTable(str(tmp_path / "t"), first.drop("at").schema, ("eval_run_id", "row_index"), ("id",))
    table.upsert(first, 0, "at")
    table.upsert(second, 1, "at")

    def state(t):
        return sorted((tuple(r) for r in t.current(spark).collect()), key=str)

    want = [("r", 0, "a", "again"), ("r", 1, "b", None), ("s", 0, "e", "new")]
    assert state(table) == want
    table.upsert(second, 1, "at")  # replay
    assert state(table) == want
    compacted = table.compact(spark, str(tmp_path / "t2"))
    assert state(compacted) == want
    compacted.upsert(batch(spark, [("s", 0, "f", "newer", 1)]), 0, "at")  # a fresh stream starts at 0
    assert state(compacted) == [*want[:2], ("s", 0, "e", "newer")]
    with pytest.raises(ValueError, match="numbered from 0"):
        compacted.upsert(first, -1, "at")


# --- export ---------------------------------------------------------------------------


def export_frame(spark):
    verdict = "struct<score:double,passed:boolean,weight:double,error:string,reasoning:string,details_json:string>"
    results = spark.createDataFrame(
        [
            ("r1", "x1", 0, "in, put", "ex", 'say "yes"', True, 0.5, 12, 3, None, None,
             {"custom:clarity": (0.5, True, 1.0, None, "clear", '{"a": 1}'), "llm_judge": (1.0, None, 1.0, None, None, None)}),
            ("r1", "x2", 1, "i", "e", None, None, None, None, None, None, "API error", None),
        ],
        "eval_run_id string, result_id string, row_index int, input_data string, expected_output string, actual_output string, "
        f"passed boolean, score double, latency_ms int, input_tokens int, output_tokens int, error string, details map<string,{verdict}>",
    ).withColumn("created_at", F.lit("2024-05-01 10:00:00").cast("timestamp_ntz"))
    runs = spark.createDataFrame(
        [("r1", "completed", "Cfg", None, 0.75)], "id string, status string, config_name string, dataset_name string, accuracy double",
    ).select("*", F.struct("accuracy").alias("summary"), *[
        F.lit("2024-05-01 09:00:00").cast("timestamp_ntz").alias(c) for c in ("created_at", "started_at", "completed_at")])
    return exports.run_export(results, runs)


def test_run_export_columns(spark):
    df = export_frame(spark)
    fixed = [*exports.RUN_COLUMNS, *exports.RESULT_COLUMNS]
    graded = [f"grader_{g}_{c}" for g in ("custom_clarity", "llm_judge") for c in exports.GRADER_COLUMNS]
    assert df.columns == fixed + graded and len(fixed) == 22
    one, two = df.orderBy("row_index").collect()
    assert one["run_summary_json"] == '{"accuracy": 0.75}' and one["passed"] == "True" and one["dataset_name"] == ""
    assert one["token_usage_json"] == '{"input_tokens": 3}'
    assert one["grader_custom_clarity_score"] == "0.5" and one["grader_custom_clarity_reasoning"] == "clear"
    assert one["grader_llm_judge_passed"] == ""
    assert json.loads(one["grader_llm_judge_details_json"]) == {"passed": None, "score": 1.0, "weight": 1.0}
    assert json.loads(one["comparer_details_json"])["custom:clarity"] == {
        "a": 1, "passed": True, "reasoning": "clear", "score": 0.5, "weight": 1.0}
    assert two["error"] == "API error" and two["grader_llm_judge_score"] == "" and two["comparer_details_json"] == ""


def test_export_of_graded_rows_has_whole_details(spark):
    rows = spark.createDataFrame([(1, 0, '{"k": "a"}', "a"), (1, 1, "junk", "a")], "eval_run_id long, row_index int, actual_output string, expected_output string")
    built = graders.build_graders([
        {"type": "exact_match", "name": "same", "threshold": None},
        {"type": "json_field", "name": "field", "field_name": "k"},
        {"type": "python", "name": "user", "source_code": "def grade(sample, item):\n    return 0.5", "weight": 2.0},
    ], graders.Context())
    graded = graders.grade(rows, built)
    results = graded.select(
        "*", F.col("row_index").alias("result_id"), F.lit("in").alias("input_data"), F.lit(1).alias("latency_ms"),
        F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit("2024-05-01").cast("timestamp_ntz").alias("created_at"))
    if "error" not in results.columns:
        results = results.withColumn("error", F.lit(None).cast("string"))
    at = [F.lit("2024-05-01").cast("timestamp_ntz").alias(c) for c in ("created_at", "started_at", "completed_at")]
    runs = spark.range(1, 2).select("id", F.lit("completed").alias("status"), F.lit("c").alias("config_name"),
        F.lit("d").alias("dataset_name"), F.struct(F.lit(1.0).alias("accuracy")).alias("summary"), *at)
    one, two = exports.run_export(results, runs, ["field"]).orderBy("row_index").collect()
    whole = json.loads(one["comparer_details_json"])
    assert list(whole) == ["field", "same", "user"]  # all verdicts, whatever columns were asked for
    assert whole["field"] == {"extracted_value": "a", "field_name": "k", "grader_name": "field", "passed": True, "score": 1.0,
        "threshold": 0.7, "weight": 1.0}
    assert json.loads(one["grader_field_details_json"]) == whole["field"]
    assert whole["same"]["threshold"] is None and whole["same"]["passed"] is None and whole["same"]["grader_name"] == "same"
    assert whole["user"]["score"] == 0.5 and whole["user"]["weight"] == 2.0
    assert "Failed to parse" in json.loads(two["comparer_details_json"])["field"]["error"]


def test_export_file_reads_back(spark, tmp_path):
    df = export_frame(spark)
    exports.write_export(df.coalesce(1), str(tmp_path / "e"))
    part = next((tmp_path / "e").glob("part-*.csv"))
    with part.open(encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    assert sorted(r["actual_output"] for r in rows) == ["", 'say "yes"']


def test_key_collisions(spark):
    names = spark.createDataFrame([("a b",), ("A-B",), ("c",)], "grader string")
    assert [tuple(r) for r in exports.key_collisions(names).collect()] == [("grader_a_b", 2)]


# --- paged source --------------------------------------------------------------------------


def item(n):
    return {"q": f"q{n}"}


def pages_by_number(params, body):
    n = int(params["page"])
    return {"items": [item(n * 10 + i) for i in range(2)] if n <= 5 else [], "asked": params}


def pages_by_offset(params, body):
    start, size = body["skip"], body["take"]
    return {"items": [item(i) for i in range(start, min(start + size, 23))], "meta": {"more": start + size < 23}}


def pages_by_token(params, body):
    n = int(params.get("cursor", "0"))
    return {"items": [item(n)], "paging": {"next": str(n + 1) if n < 4 else None}}


def read(spark, fetch, **options):
    register_paged_json(spark, "pages_test", fetch)
    return spark.read.format("pages_test").options(**options).load()


@pytest.mark.parametrize("parallel", ["1", "3", "9"])
def test_page_mode_reads_every_page(spark, parallel):
    pages = read(spark, pages_by_number, mode="page", records_path="$.items", parallel_pages=parallel)
    kept = paging.cut_tail(pages, [], F.col("has_more"))
    texts = kept.orderBy("page_index").collect()
    found = [q["q"] for r in texts for q in json.loads(r["payload"])["items"]]
    assert found == [f"q{n * 10 + i}" for n in range(1, 6) for i in range(2)]
    assert json.loads(texts[0]["request"])["params"] == {"page": 1}


@pytest.mark.parametrize("fails_behind", [False, True])
def test_parallel_tasks_share_the_pages(spark, fails_behind):
    def numbered(params, body):
        if fails_behind and params["page"] > 100:
            raise OSError("no such page")
        return {"items": [item(params["page"])], "more": params["page"] < 100}

    pages = read(spark, numbered, mode="page", config='{"has_more_path": "$.more"}', parallel_pages="4")
    rows = pages.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["page_index"] for r in rows) == list(range(100))
    counts = {t: sum(r["task"] == t for r in rows) for t in range(4)}
    assert max(counts.values()) == 25


def test_parallel_tasks_end_at_the_first_page_without_a_next(spark):
    def in_rounds(params, body):  # numbers behind the end begin anew
        return {"items": [item(params["page"])], "more": params["page"] % 10 != 0}

    pages = read(spark, in_rounds, mode="page", config='{"has_more_path": "$.more"}', parallel_pages="3")
    kept = paging.cut_tail(pages, [], F.col("has_more"))
    assert sorted(r["page_index"] for r in kept.collect()) == list(range(10))


def test_served_pages_read_the_files_that_hold_them(spark, tmp_path, monkeypatch):
    import pyarrow.dataset as ds

    from gradeloom.plans import flows

    monkeypatch.setattr(flows, "SERVED_ROWS", 50)
    keys = [*range(500), 7, None]
    rows = spark.createDataFrame([(k, f"n{k}") for k in keys], "c_custkey long, c_name string")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    fetch = flows._customer_pages(spark, str(tmp_path))
    opened, dataset = [], ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda *a, **k: opened.append(a) or dataset(*a, **k))
    for start in range(0, 520, 20):
        found = fetch({"offset": start, "limit": 20}, None)
        wanted = sorted(k for k in keys if k is not None and start <= k < start + 20)
        assert sorted(r["c_custkey"] for r in found["items"]) == wanted
        assert found["meta"]["more"] == (len(wanted) == 20)
    assert 25 <= len(opened) <= 50


def test_offset_mode_in_the_body(spark):
    config = {"offset_param": "skip", "limit_param": "take", "page_size": 10, "has_more_path": "$.meta.more", "placement": "body"}
    pages = read(spark, pages_by_offset, mode="offset", config=json.dumps(config), body='{"scope": "all"}', parallel_pages="2")
    rows = pages.orderBy("page_index").collect()
    assert [r["position"] for r in rows] == ["0", "10", "20"] and [r["has_more"] for r in rows] == [True, True, False]
    assert json.loads(rows[1]["request"])["body"] == {"scope": "all", "skip": 10, "take": 10}
    bigger = read(spark, pages_by_offset, mode="offset", config=json.dumps(config), body="{}", page_size="25")
    assert bigger.count() == 1


def test_token_mode_follows_the_chain(spark):
    config = {"token_param": "cursor", "response_token_path": "$.paging.next"}
    pages = read(spark, pages_by_token, mode="next_token", config=json.dumps(config), parallel_pages="4")
    rows = pages.orderBy("page_index").collect()
    assert [r["position"] for r in rows] == [None, "1", "2", "3", "4"]


def test_no_paging_reads_once_and_unknown_modes_fail(spark):
    assert read(spark, lambda params, body: {"items": [1]}, mode="none").count() == 1
    with pytest.raises(ValueError, match="Unsupported pagination mode"):
        Pager({"mode": "spiral"})


def test_page_size_rules():
    def pager(mode, size=None, **config):
        options = {"mode": mode, "config": json.dumps(config)}
        return Pager(options | ({"page_size": size} if size else {}))

    assert pager("offset").size == 50 and pager("page").size is None
    assert pager("offset", page_size="x").size == 50 and pager("offset", page_size=True).size == 50
    assert pager("page", page_size=" 20 ").size == 20 and pager("page", "7", page_size=20).size == 7
    assert pager("page", page_size=20).request(3)[0] == {"page": 3}
    assert pager("page", page_size=20, page_size_param="n").request(3)[0] == {"page": 3, "n": 20}


def test_unknown_mode_stops_the_job(spark):
    df = spark.createDataFrame([("spiral",)], "mode string")
    with pytest.raises(Exception, match="Unsupported pagination mode"):
        df.select(paging.checked_mode(F.col("mode"))).collect()


# --- discovery ---------------------------------------------------------------------------------


def test_paths(spark):
    body = {"data": {"items": [{"q": 1, "tags": ["x"]}] * 5 + [{"late": []}], "none": {}}, "n": None}
    df = spark.createDataFrame([(json.dumps(body),), (None,), ('[{"a": {}}]',)], "b string")
    assert [r["path"] for r in discover.array_paths(df, "b", sample=5).collect()] == ["$", "$.data.items", "$.data.items[].tags"]
    assert "$.data.items[].late" in [r["path"] for r in discover.array_paths(df, "b").collect()]
    with pytest.raises(Exception, match="Expecting value"):
        discover.array_paths(spark.createDataFrame([("broken",)], "b string"), "b").collect()
    fields = [r["path"] for r in discover.field_paths(df, "b", sample=5).collect()]
    assert fields == ["$", "$[].a", "data.items", "data.items[].q", "data.items[].tags", "data.items[].tags[]", "data.none", "n"]


def test_first_records_are_a_sample(spark):
    df = spark.createDataFrame([(i, json.dumps({f"f{i}": i})) for i in range(9)], "i int, b string")
    sample = discover.first_records(df, "i")
    assert [r["path"] for r in discover.field_paths(sample, "b").collect()] == ["f0", "f1", "f2", "f3", "f4"]


# --- translation -----------------------------------------------------------------------------------


def make_translator(spark, broken=()):
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def translator(instruction, request):
        inputs = json.loads(request)["inputs"]
        calls.add(1)
        sizes.add(len(inputs))
        assert len(inputs) <= translate.BATCH_SIZE
        if len(inputs) > 1 and any(t in broken for t in inputs):
            return "not json"
        if inputs == ["never"]:
            return '{"translations": [1]}'
        return json.dumps({"translations": [f"T:{t}" for t in inputs]})

    return translator, calls, sizes


def test_repeats_and_cached_texts_cost_nothing(spark):
    rows = [(i, f"text {i % 51}", "same") for i in range(120)] + [(200, "", "same"), (201, None, "hit")]
    df = spark.createDataFrame(rows, "id int, input string, note string").coalesce(1)
    cache = spark.createDataFrame([("hit", "C:hit")], "source_text string, translated_text string").select(
        translate.cache_key(F.lit("dutch"), F.col("source_text")).alias("cache_key"), "source_text", "translated_text")
    translator, calls, sizes = make_translator(spark)
    out, fresh = translate.translate_columns(df, ["input", "note"], " Dutch ", translator, spread_by=["id"], cache=cache)
    got = {r["id"]: (r["input"], r["note"]) for r in out.collect()}
    assert got[0] == ("T:text 0", "T:same") and got[200] == ("", "T:same") and got[201] == ("", "C:hit")
    assert len(got) == 122 and fresh.count() == 52 and sizes.value == 52
    out.count()
    assert sizes.value == 52  # using the result again asks nothing again


def test_malformed_batches_are_retried_one_by_one(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "id int, input string").coalesce(1)
    translator, calls, sizes = make_translator(spark, broken=("t2",))
    out, _ = translate.translate_columns(df, ["input"], "Dutch", translator, spread_by=["id"])
    assert sorted(r["input"] for r in out.collect()) == ["T:t0", "T:t1", "T:t2", "T:t3"]
    df = spark.createDataFrame([(0, "never")], "id int, input string")
    with pytest.raises(Exception, match="list of 1 strings"):
        translate.translate_columns(df, ["input"], "Dutch", translator, spread_by=["id"])


def test_translation_arguments(spark):
    df = spark.createDataFrame([(0, "x")], "id int, input string")
    for fields, language, message in [([" "], "Dutch", "fields"), (["input"], " ", "language"), (["gone"], "Dutch", "include gone")]:
        with pytest.raises(ValueError, match=message):
            translate.translate_columns(df, fields, language, lambda i, r: "", spread_by=["id"])


def test_reply_shapes(spark):
    replies = ['{"translations": ["a", "b"]}', '{"translations": ["a"]}', '{"translations": ["a", 1]}', "[]", "x", '{"translations": ["a", null]}']
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [r[0] for r in df.select(translate.parse_reply(F.col("r"), F.lit(2))).collect()]
    assert got == [["a", "b"], None, None, None, None, None]
