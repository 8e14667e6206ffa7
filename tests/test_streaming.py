from __future__ import annotations

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import graders
from gradeloom.operators.summary import run_summary
from gradeloom.session import cut_lineage, fresh_dir, shared_dir
from gradeloom.sources.keyed_table import KeyedTable
from gradeloom.sources.paged_json import Pager, _ChainStreamReader, _PageStreamReader, register_paged_json
from gradeloom.sources.records import extract_json_records
from gradeloom.streaming import grade_stream, heartbeat, paged_stream, running

OUTPUTS = "id string, eval_run_id long, row_index int, expected_output string, actual_output string, error string, at int"


def grade(batch):
    built = graders.build_graders([{"type": "exact_match", "name": "same"}], graders.Context())
    return graders.grade(batch, built).drop("details")


def feed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_grading_survives_a_restart_and_replays(spark, tmp_path):
    inbox, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    feed(spark, inbox, "a", [("i1", 1, 0, "x", "x", None, 1), ("i2", 1, 1, "x", "y", None, 2)], OUTPUTS)
    stream = spark.readStream.schema(OUTPUTS).option("recursiveFileLookup", "true").parquet(inbox)
    schema = grade(spark.createDataFrame([], OUTPUTS)).drop("at").schema
    table = KeyedTable(str(tmp_path / "table"), schema, ("eval_run_id", "row_index"), ("id",))

    def step():
        grade_stream.start_grading(
            stream, grade, table, str(tmp_path / "ck"), order="at").awaitTermination()
        running.start_progress(spark, table, progress, str(tmp_path / "ck2")).awaitTermination()
        return {(r["eval_run_id"], r["row_index"]): (r["id"], r["passed"]) for r in table.current(spark).collect()}

    assert step() == {(1, 0): ("i1", True), (1, 1): ("i2", False)}
    # A row again (late write wins), one twice inside a batch, and another run.
    feed(spark, inbox, "b", [("i3", 1, 1, "x", "x", None, 1), ("i4", 2, 0, "x", None, "boom", 1), ("i5", 2, 0, "x", "x", None, 2)], OUTPUTS)
    assert step() == {(1, 0): ("i1", True), (1, 1): ("i2", True), (2, 0): ("i4", True)}
    assert step() == {(1, 0): ("i1", True), (1, 1): ("i2", True), (2, 0): ("i4", True)}  # nothing new
    done = {r["eval_run_id"]: r["progress"] for r in running.latest_progress(spark, progress).collect()}
    assert done == {1: 2, 2: 1}
    runs = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "eval_run_id long, total_rows long")
    view = grade_stream.progress_view(running.latest_progress(spark, progress), runs).collect()
    assert sorted((r["eval_run_id"], r["percent"]) for r in view) == [(1, 67), (2, 100), (3, 0)]


def test_running_summary_ignores_repeats(spark, tmp_path):
    schema = "eval_run_id long, row_index int, score double, passed boolean, error string, latency_ms int, input_tokens int, output_tokens int, created_at timestamp"
    now = dt.datetime(2024, 1, 1, 12)
    inbox = str(tmp_path / "in")
    rows = [(1, 0, 1.0, True, None, 10, 1, 1, now), (1, 1, 0.0, False, None, 20, 1, 1, now), (1, 0, 1.0, True, None, 10, 1, 1, now)]
    feed(spark, inbox, "a", rows, schema)
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
    seen = []

    def land(batch, batch_id):
        seen.extend((batch_id, r["eval_run_id"], r["total"], r["accuracy"]) for r in batch.collect())

    def step():
        seen.clear()
        grade_stream.streaming_summary(stream, watermark="1 hour").writeStream.outputMode("update").foreachBatch(land).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return {(run, total, accuracy) for _, run, total, accuracy in seen}

    assert step() == {(1, 2, 0.5)}
    feed(spark, inbox, "b", [(1, 1, 0.0, False, None, 20, 1, 1, now), (1, 2, 1.0, True, None, 5, 1, 1, now), (2, 0, 1.0, True, None, 5, 1, 1, now)], schema)
    assert step() == {(1, 3, 2 / 3), (2, 1, 1.0)}


RESULTS = "eval_run_id long, row_index long, at int, score double, passed boolean, error string, latency_ms int, input_tokens int, output_tokens long"


def summaries(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_summaries_follow_every_change(spark, tmp_path):
    """Rows that come again, late, several times in a file or in another order, over many small batches."""
    rng = random.Random(11)

    def result(run, row, at):
        score = rng.choice([None, 0.1, 1 / 3, rng.random(), 2.0**-70, 1e9])
        error = rng.choice([None, None, "", "boom"])
        passed = rng.choice([True, False, None])
        return (run, row, at, score, passed, error, *(rng.choice([None, rng.randint(0, 9999)]) for _ in range(3)))

    files = []
    for k in range(8):
        rows = [result(rng.choice([1, 2, None]), rng.choice([0, 1, 4095, 4096, rng.randint(-9000, 9000)]), i) for i in range(30)]
        files.append(rng.sample(rows, len(rows)))
    files.append(files[0])
    inbox, target, late = str(tmp_path / "in"), str(tmp_path / "sums"), {}
    for k, rows in enumerate(files):
        feed(spark, inbox, f"f{k}", rows, RESULTS)
        if k in (0, 3, 8):
            stream = spark.readStream.schema(RESULTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(inbox)
            running.start_summary(stream, target, str(tmp_path / "ck"), order="at").awaitTermination()
        for r in sorted(rows, key=lambda r: r[2]):
            late[r[:2]] = r
        if k in (0, 3, 8):
            want = run_summary(spark.createDataFrame(list(late.values()), RESULTS))
            assert summaries(running.latest_summary(spark, target)) == summaries(want)
    running.compact(spark, target, str(tmp_path / "compacted"))
    assert summaries(running.latest_summary(spark, str(tmp_path / "compacted"))) == summaries(want)


def test_the_later_write_of_a_file_counts(spark, tmp_path):
    for name, rows in (("a", [(1, 0, 1, 0.0, False), (1, 0, 2, 1.0, True)]), ("b", [(1, 0, 2, 1.0, True), (1, 0, 1, 0.0, False)])):
        feed(spark, str(tmp_path / name), "f", [(*r, None, 1, 1, 1) for r in rows], RESULTS)
        stream = spark.readStream.schema(RESULTS).option("recursiveFileLookup", "true").parquet(str(tmp_path / name))
        running.start_summary(stream, str(tmp_path / f"{name}-sums"), str(tmp_path / f"{name}-ck"), order="at").awaitTermination()
        (found,) = running.latest_summary(spark, str(tmp_path / f"{name}-sums")).collect()
        assert (found["total"], found["passed"], found["failed"], found["avg_score"]) == (1, 1, 0, 1.0)


def test_scores_that_are_no_numbers_can_be_replaced(spark, tmp_path):
    inbox, target = str(tmp_path / "in"), str(tmp_path / "sums")
    found = []
    for k, score in enumerate((float("nan"), float("inf"), 0.5)):
        feed(spark, inbox, f"f{k}", [(1, 0, 1, score, None, None, 1, 1, 1), (1, 1 + k, 1, 0.25, None, None, 1, 1, 1)], RESULTS)
        stream = spark.readStream.schema(RESULTS).option("recursiveFileLookup", "true").parquet(inbox)
        running.start_summary(stream, target, str(tmp_path / "ck"), order="at").awaitTermination()
        found.append(running.latest_summary(spark, target).first()["avg_score"])
    assert [str(x) for x in found] == ["nan", "nan", "0.3125"]


def test_a_batch_touches_the_state_of_its_rows_only(spark, tmp_path):
    inbox = str(tmp_path / "in")
    many = [(1, i, 1, 1.0, True, None, 1, 1, 1) for i in range(5 * running.BLOCK_ROWS)]
    feed(spark, inbox, "a", many, RESULTS)
    stream = spark.readStream.schema(RESULTS).option("recursiveFileLookup", "true").parquet(inbox)

    def step():
        query = running.start_summary(stream, str(tmp_path / "sums"), str(tmp_path / "ck"), order="at")
        query.awaitTermination()
        (state,) = query.lastProgress["stateOperators"]
        return state["numRowsUpdated"], state["numRowsTotal"]

    assert step() == (5, 5)
    feed(spark, inbox, "b", [(1, 7, 1, 0.0, False, None, 1, 1, 1), (1, 5000, 1, 0.0, False, None, 1, 1, 1)], RESULTS)
    assert step() == (2, 5)
    (found,) = running.latest_summary(spark, str(tmp_path / "sums")).collect()
    assert (found["total"], found["failed"]) == (len(many), 2)


BEATS = "eval_run_id long, ts timestamp, ended boolean"


def minute(m):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=m)


@pytest.fixture
def watcher(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def step(name, rows):
        feed(spark, inbox, name, [(k, minute(m), e) for k, m, e in rows], BEATS)
        stream = spark.readStream.schema(BEATS).option("recursiveFileLookup", "true").parquet(inbox)
        heartbeat.failed_runs(stream, watermark="0 seconds").writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        fields = "eval_run_id long, status string, last_heartbeat timestamp, failed_at timestamp, error_message string"
        rows = spark.read.schema(fields).parquet(out).collect()
        return sorted((r["eval_run_id"], (r["failed_at"] - minute(0)).total_seconds() / 60) for r in rows)

    return step


def test_silent_runs_fail_once(watcher):
    assert watcher("a", [(1, 0, False), (1, 20, False), (2, 0, False), (2, 25, True), (3, 0, False)]) == []
    # Run 3 is late, run 1 goes on, and the clock moves to minute 45.
    assert watcher("b", [(1, 45, False)]) == [(3, 30.0)]
    # A heartbeat after the failure changes nothing.
    assert watcher("c", [(3, 50, False), (1, 60, False), (9, 95, False)]) == [(1, 90.0), (3, 30.0)]
    assert watcher("d", [(9, 100, False)]) == [(1, 90.0), (3, 30.0)]


def test_a_gap_inside_one_batch_counts(watcher):
    got = watcher("a", [(1, 0, False), (1, 10, False), (1, 90, False), (2, 0, False), (2, 29, False), (2, 59, False), (2, 85, False)])
    assert got == [(1, 40.0)]


def test_closed_runs_leave_the_state(spark, tmp_path):
    inbox = str(tmp_path / "in")

    def step(name, rows):
        feed(spark, inbox, name, [(k, minute(m), e) for k, m, e in rows], BEATS)
        stream = spark.readStream.schema(BEATS).option("recursiveFileLookup", "true").parquet(inbox)
        query = heartbeat.failed_runs(stream, watermark="0 seconds", remember_days=1 / 24).writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        failed = spark.read.schema("eval_run_id long").parquet(str(tmp_path / "out")).collect()
        return sorted(r[0] for r in failed), query.lastProgress["stateOperators"][-1]["numRowsTotal"]

    assert step("a", [(1, 0, False), (2, 0, False), (2, 20, True), (3, 40, False)]) == ([1], 3)
    # Closed runs are remembered for an hour after their last heartbeat: run 1 speaks up again, run 2 does not.
    assert step("b", [(1, 50, False), (3, 60, False)]) == ([1], 3)
    assert step("c", [(3, 85, False)]) == ([1], 2)
    assert step("d", [(3, 111, False)]) == ([1], 1)
    assert step("e", [(1, 112, False), (9, 112, False)]) == ([1], 3)


def test_spans_from_many_partitions_meet(spark, watcher, tmp_path):
    rows = [(7, m, False) for m in range(0, 300, 10)] + [(8, m, False) for m in (0, 200)]
    assert watcher("a", rows) == [(8, 30.0)]


@pytest.mark.parametrize("mode", ["page", "next_token"])
def test_paged_import_follows_the_source(spark, tmp_path, mode):
    def fetch(params, body):
        n = int(params.get("page", params.get("page_token", 1)))
        return {"items": [{"q": f"q{n}"}] if n <= 5 else [], "next_token": str(n + 1) if n < 5 else None}

    register_paged_json(spark, "pages_stream", fetch)
    target = str(tmp_path / "rows")

    def to_rows(pages):
        return extract_json_records(pages, "payload", "$.items", []).select(
            F.get_json_object("record", "$.q").alias("input"))

    options = {"mode": mode, "records_path": "$.items", "pages_per_trigger": "2", "pages_per_task": "2"}

    def run(wanted):
        query = paged_stream.start_import(spark, "pages_stream", options, to_rows, target, str(tmp_path / "ck"), interval="100 milliseconds")
        try:
            for _ in range(300):
                time.sleep(0.1)
                try:
                    got = sorted(r["input"] for r in spark.read.schema("input string").parquet(target).collect())
                except Exception:  # nothing written yet
                    got = []
                if len(got) >= wanted or query.exception():
                    break
        finally:
            query.stop()
        return got

    assert set(run(2)) >= {"q1", "q2"}
    assert run(5) == ["q1", "q2", "q3", "q4", "q5"]  # the restart goes on, nothing twice


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    assert fresh_dir(spark, "x").startswith(folder) and fresh_dir(spark, "x") != fresh_dir(spark, "x")
    df = spark.range(5).withColumn("r", F.rand())
    cut = cut_lineage(df)
    assert cut.collect() == cut.collect() and cut.dtypes == df.dtypes


@pytest.mark.parametrize("pages", [0, 1, 2, 3, 7, 8, 9, 100])
def test_page_count_probes_are_few(pages):
    asked = []

    def fetch(params, body):
        asked.append(params["page"])
        return {"items": [params["page"]] if params["page"] <= pages else []}

    reader = _PageStreamReader(Pager({"mode": "page", "records_path": "$.items"}), fetch, 10)
    # Without a flag or a page size the last page may still grow.
    assert reader.latestOffset() == {"pages": max(pages - 1, 0), "open": min(pages, 1)}
    assert len(asked) <= 2 * max(pages, 1).bit_length() + 3
    parts = reader.partitions({"pages": 0, "open": 0}, {"pages": max(pages - 1, 0), "open": min(pages, 1)})
    assert [i for p in parts for i in range(p.first, p.last)] == list(range(pages))


def read_new(reader, start):
    end = reader.latestOffset()
    rows = [row for part in reader.partitions(start, end) for row in reader.read(part)]
    reader.commit(end)
    return [x for row in rows for x in json.loads(row[4])["items"]], end


@pytest.mark.parametrize("config", [{}, {"page_size": 2}, {"page_size": 2, "has_more_path": "$.more"}])
def test_a_page_that_fills_up_loses_nothing(config):
    items = [1, 2, 3]

    def fetch(params, body):
        at = (params["page"] - 1) * 2
        return {"items": items[at : at + 2], "more": at + 2 < len(items)}

    reader = _PageStreamReader(Pager({"mode": "page", "config": json.dumps(config), "records_path": "$.items"}), fetch, 1)
    got, at = read_new(reader, reader.initialOffset())
    assert got == [1, 2, 3]
    for new in ([4], [5], [], [6, 7, 8, 9]):
        items += new
        got, at = read_new(reader, at)
        assert got == new
    again = _PageStreamReader(reader.pager, fetch, 2)  # a restart goes on at the offset
    items += [10, 11]
    assert read_new(again, at)[0] == [10, 11]


def test_flags_and_repeated_pages_end_the_probing():
    def clamped(params, body):
        return {"items": ["first", "second", "last"][min(params["page"], 3) - 1 :][:1], "more": params["page"] < 3}

    for config, complete in (({"has_more_path": "$.more"}, 2), ({}, 2)):
        pager = Pager({"mode": "page", "config": json.dumps(config), "records_path": "$.items"})
        assert _PageStreamReader(pager, clamped, 1).latestOffset() == {"pages": complete, "open": 1}


def test_a_chain_goes_on_when_a_token_appears():
    pages = {None: (["a"], "t1"), "t1": (["b"], None)}

    def fetch(params, body):
        items, token = pages[params.get("page_token")]
        return {"items": items, "next_token": token}

    reader = _ChainStreamReader(Pager({"mode": "next_token", "records_path": "$.items"}), fetch, 10)

    def step(start):
        rows, end = reader.read(start)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(start, end)) == rows
        return [x for row in rows for x in json.loads(row[4])["items"]], end

    got, at = step(reader.initialOffset())
    assert got == ["a", "b"]
    assert step(at) == ([], at)
    pages["t1"] = (["b", "c"], None)
    got, at = step(at)
    assert got == ["c"]
    pages.update({"t1": (["b", "c"], 0), 0: (["d"], None)})
    assert step(at)[0] == ["d"]


def test_parts_of_late_events_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from gradeloom.plans import flows

    inbox = tmp_path / "inbox"
    monkeypatch.setattr(flows, "INBOX_ROWS", 100)
    monkeypatch.setattr(flows, "fresh_dir", lambda *_: str(inbox))
    rows = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS ts", "id % 7 AS user_id",
        "'view' AS event_type", "1.0D AS value", "'{}' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    stream = flows._late_event_stream(spark, str(tmp_path))
    files = list(Path(inbox).glob("*.parquet"))
    assert len(files) == 15  # five parts of three files
    query = stream.select("event_id").writeStream.format("memory").queryName("late_parts").trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.table("late_parts").groupBy("event_id").count().collect()
    assert sorted(r["event_id"] for r in held) == list(range(1000))


def test_state_change_takes_rows_that_repeat_nothing_unsorted(monkeypatch):
    import pandas as pd

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    frame = pd.DataFrame({"row": [2, 1], "place": [1, 2], "flags": [1, 2], "latency": [3, 4], "input_tokens": [5, 6], "output_tokens": [7, 8], "score": [0.5, 1.0]})
    again = pd.concat([frame, frame.assign(place=0, latency=9)])
    (sorted_,) = running._change((1, 0), iter([again]), State())
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *a, **k: pytest.fail("sorted"))
    (plain,) = running._change((1, 0), iter([frame]), State())
    assert plain["sums"][0] == sorted_["sums"][0] == [2, 1, 1, 0, 0, 0, 0, 0, 0, 7, 11, 15]
    assert plain["score"][0] == sorted_["score"][0] == int(1.5 * 2**60)
