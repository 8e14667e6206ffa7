"""Numbering, neighbours, lookups and merges, also with one key that owns most rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import joins, merge
from gradeloom.operators import browse, ordinals, page_index
from gradeloom.operators.ordinals import enumerate_rows, id_cell, number_sorted, with_neighbour, with_ordinal


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows belong to key 0; ids have gaps."""
    return spark.range(3000).select(
        (F.col("id") * 7).alias("id"),
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 11).cast("long").alias("k"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"),
    )


@pytest.mark.parametrize("width", [1, 100, 1 << 20])
def test_ordinals_do_not_depend_on_the_cell_width(skewed, width):
    got = with_ordinal(skewed, ["k"], "id", "pos", cell=id_cell("id", width))
    want = skewed.withColumn("pos", (F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1).cast("long"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_no_row_is_lost_without_key_or_order(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), ("a", 3), (None, 1)], "k string, id long")
    got = sorted((tuple(r) for r in with_ordinal(df, ["k"], "id", "pos").collect()), key=str)
    assert got == sorted([("a", 5, 2), ("a", None, 0), ("a", 3, 1), (None, 1, None)], key=str)


def test_ordinals_of_the_whole_table(skewed):
    got = with_ordinal(skewed, [], "id", "pos", cell=id_cell("id", 50)).orderBy("id")
    assert [r["pos"] for r in got.collect()] == list(range(3000))


def test_positions_of_hashed_ids_and_equal_times(spark):
    hashed = spark.range(2000).select(F.xxhash64("id").alias("id"), F.lit(None).cast("timestamp").alias("created_at"))
    want = sorted(r["id"] for r in hashed.collect())
    got = {r["id"]: r["n"] for r in number_sorted(hashed, [F.col("created_at"), F.col("id")], "n").collect()}
    assert [got[i] for i in want] == list(range(2000))
    loaded = spark.range(12_000).select("id", F.lit("2024-01-01").cast("timestamp").alias("created_at")).repartition(4)
    assert [r["id"] for r in browse.page(loaded, 110, 100).collect()] == list(range(1099, 999, -1))


def test_pages_from_written_ranges(spark, tmp_path):
    at = F.when(F.col("id") % 5 != 0, F.timestamp_seconds(F.xxhash64("id") % 50))
    rows = spark.range(5000).select(F.xxhash64("id").alias("id"), at.alias("created_at"), F.lit("x").alias("v")).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        page_index.write_page_index(rows, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = browse.newest_first(rows).collect()
    places = [p.name for p in (tmp_path / "rows").iterdir() if p.name.startswith("_range")]
    assert len(places) > 3
    for number in (1, 2, 17, 49, 50, 51):
        got = page_index.indexed_page(spark, str(tmp_path), number, 100)
        assert got.collect() == want[(number - 1) * 100 : number * 100]
        if got.isEmpty():
            continue
        plan = got._jdf.queryExecution().executedPlan().toString()
        filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
        assert 1 <= len(set(re.findall(r"\b[0-9]+\b", re.sub(r"#[0-9]+L?", "", filters)))) <= 2, filters  # of all ranges
    with pytest.raises(ValueError):
        page_index.indexed_page(spark, str(tmp_path), 0)
    page_index.write_page_index(rows.limit(0), str(tmp_path))
    assert page_index.indexed_page(spark, str(tmp_path)).collect() == []


def test_pages_by_cursor(spark):
    at = F.when(F.col("id") % 5 != 0, F.timestamp_seconds(F.col("id") % 3))
    rows = spark.range(60).select("id", at.alias("created_at"))
    want, got = [r["id"] for r in browse.newest_first(rows).collect()], []
    page = browse.newest_first(rows).limit(7).collect()
    while page:
        got += [r["id"] for r in page]
        last = page[-1]
        page = browse.page_after(rows, F.lit(last["created_at"]), F.lit(last["id"]), 7).collect()
    assert got == want


@pytest.mark.parametrize("width", [1, 100, 1 << 20])
@pytest.mark.parametrize("following", [False, True])
def test_neighbours_cross_cells(skewed, width, following):
    got = with_neighbour(skewed, ["k"], ["id"], ["v"], "n", cell=id_cell("id", width), following=following)
    shift = F.lead if following else F.lag
    want = skewed.withColumn("n", shift("v").over(Window.partitionBy("k").orderBy("id")))
    assert sorted(got.select("id", "n.v").collect(), key=str) == sorted(
        want.select("id", F.col("n").alias("v")).collect(), key=str)


def busy(spark, kind):
    """4,000 rows, most of one key: hashed ids, few times, one time for all, or no time."""
    at = {
        "hashed": F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10**6))),
        "few": F.timestamp_seconds(F.col("id") % 3),
        "one": F.timestamp_seconds(F.lit(7)),
        "none": F.when(F.col("id") % 4 == 0, F.timestamp_seconds("id")),
    }[kind]
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 50).cast("long").alias("k"),
        at.alias("at"), F.xxhash64("id").alias("id"))
    return rows.repartition(5)


@pytest.mark.parametrize("kind", ["hashed", "few", "one", "none"])
@pytest.mark.parametrize("following", [False, True])
def test_neighbours_in_cells_that_fit(spark, kind, following):
    rows = busy(spark, kind)
    shift = F.lead if following else F.lag
    want = rows.withColumn("n", shift("id").over(Window.partitionBy("k").orderBy("at", "id")))
    got = with_neighbour(rows, ["k"], ["at", "id"], ["id"], "n", following=following, target_rows=100)
    assert sorted(got.select("k", "id", "n.id").collect(), key=str) == sorted(want.select("k", "id", "n").collect(), key=str)


@pytest.mark.parametrize("target_rows", [1, 100, 10_000])
def test_ordinals_in_cells_that_fit(spark, target_rows):
    rows = busy(spark, "hashed").unionByName(spark.sql("SELECT CAST(NULL AS LONG) k, timestamp '2024-01-01' at, 5L id"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1
    want = rows.withColumn("pos", F.when(F.col("k").isNotNull(), place.cast("long")))
    got = with_ordinal(rows, ["k"], "id", "pos", target_rows=target_rows)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("kind", ["hashed", "few", "one", "none"])
def test_cells_hold_about_the_target(spark, kind):
    rows = busy(spark, kind)
    cells = ordinals._fitted(rows, ["k"], ["at", "id"], 100).groupBy("k", "_cell").count().collect()
    hot = [r["count"] for r in cells if r["k"] == 0]
    assert all(r["_cell"] is None for r in cells if r["k"] != 0)
    # No cell is far beyond the target, and what is carried grows with rows / target only.
    assert max(hot) <= 250 and sum(hot) >= 2800 and len(hot) <= 3 * 2 * sum(hot) / 100


def test_rows_read_from_files_are_numbered_in_order(spark, skewed, tmp_path):
    skewed.repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    got = enumerate_rows(spark.read.parquet(str(tmp_path / "t")))
    numbers = sorted(r["row_index"] for r in got.collect())
    assert numbers == list(range(3000))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_a_plain_join_for_hot_keys(spark, skewed, how):
    facts = skewed.withColumn("k", F.when(F.col("id") % 5 != 0, F.col("k")))  # some keys are NULL
    dim = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    hot = joins.lookup_join(facts, dim, ["k"], how, spread_by=["id"], target_rows=100)
    plain = facts.join(dim, "k", how)
    assert hot.columns == plain.columns
    assert sorted(hot.collect(), key=str) == sorted(plain.collect(), key=str)


def test_hot_rows_spread_by_their_count(skewed, spark):
    dim = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    # Without broadcast the hot key must end in more than one shuffle partition.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(skewed, dim, ["k"], spread_by=["id"], target_rows=100)
        rows = joined.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) > 1 and max(r["count"] for r in rows) < sum(r["count"] for r in rows)


def test_delete_rules(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, parent long")
    gone = parents.filter("id = 1")
    assert sorted(r["id"] for r in joins.delete_cascade(children, gone, "parent", spread_by=["id"]).collect()) == [11, 12]
    blocked = {r["id"]: r["blocked"] for r in joins.delete_restricted(parents, children, "parent").collect()}
    assert blocked == {1: True, 2: True, 3: False}
    left = {r["id"]: r["parent"] for r in joins.delete_set_null(children, gone, "parent", spread_by=["id"]).collect()}
    assert left == {10: None, 11: 2, 12: None}


def test_last_write_keeps_identity_of_the_first(spark):
    rows = [("r", 0, 1, "id1", "a"), ("r", 0, 2, "id2", "b"), ("r", 1, 1, "id3", None), ("r", 0, 3, "id4", None)]
    writes = spark.createDataFrame(rows, "run string, row int, at int, id string, out string")
    got = merge.last_write(writes, ["run", "row"], F.col("at"), ["out"], ["id"]).collect()
    assert {(r["row"], r["id"], r["out"]) for r in got} == {(0, "id1", None), (1, "id3", None)}


def test_baskets(spark):
    def items(rows):
        return spark.createDataFrame(rows, "sel string, pos int, name string")

    basket = items([("p0:0", 0, "old"), ("p0:1", 1, "keep")])
    page = items([("p0:0", 0, "new"), ("p1:0", 1, "more")])
    merged = merge.merge_basket(basket, page, "sel", "pos", ["name"]).orderBy("appended", "pos").collect()
    assert [(r["sel"], r["name"]) for r in merged] == [("p0:0", "new"), ("p0:1", "keep"), ("p1:0", "more")]
    assert [r["sel"] for r in merge.remove_items(basket, page, "sel").collect()] == ["p0:1"]
    assert merge.count_selected(basket, page, "sel").first()["selected"] == 1


def test_append_fills_absent_cells(spark):
    old = spark.createDataFrame([("a", "b")], "input string, expected_output string")
    new = spark.createDataFrame([(1, "x")], "expected_output int, extra string")
    rows = merge.append_rows(old, new, ["input", "expected_output"]).collect()
    assert sorted(tuple(r) for r in rows) == [("", "1"), ("a", "b")]


def test_translation_reads_the_cache_once(spark):
    import json

    from pyspark.sql import functions as F

    from gradeloom.functions.text import cache_key
    from gradeloom.operators import compare, translate

    read = spark.sparkContext.accumulator(0)

    def count(text):
        read.add(1)
        return f"c:{text}"

    long = "long " * 40
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, ""), (4, None), (5, long), (6, "a")], "id int, text string")
    known = spark.createDataFrame([("a",), ("other",)], "source_text string")
    shown = F.udf(count, "string").asNondeterministic()
    cache = known.select(cache_key(F.lit("dutch"), F.col("source_text")).alias("cache_key"), "source_text", shown("source_text").alias("translated_text"))

    def translator(instruction, request):
        return json.dumps({"translations": [t if t == "b" else t[:-1] + "!" for t in json.loads(request)["inputs"]]})

    translated, fresh = translate.translate_columns(docs, ["text"], "Dutch", translator, spread_by=["id"], cache=cache)
    texts = {r["id"]: r["text"] for r in translated.collect()}
    assert texts == {1: "c:a", 2: "b", 3: "", 4: "", 5: long[:-1] + "!", 6: "c:a"}
    assert sorted(r["source_text"] for r in fresh.collect()) == sorted(["b", long])
    assert read.value == 2
    found = compare.changed_fields(docs, translated, ["id"], ["text"])
    assert {r["id"]: r["changed"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_comparison_joins_no_long_text(spark):
    from gradeloom.operators import compare

    rows = spark.createDataFrame([(1, "x" * 1000)], "id int, text string")
    size = lambda df: len(max((str(v) for v in df.first().asDict().values()), key=len))
    assert size(rows.select(compare._digest("text").alias("d"))) < 200
    assert rows.select((compare._digest("text") == compare._digest("text")).alias("e")).first()["e"]
