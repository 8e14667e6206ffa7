"""Registered text queries against their SQL, and the pipeline against plain stages."""

from __future__ import annotations

import duckdb
import plain
import pytest
from pyspark.sql import functions as F
from test_text_work import check_packed

import corpus_pipeline
from gradeloom.llm import quality
from gradeloom.llm.queries import LLM_CHECK_SQL, LLM_QUERIES


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in LLM_QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(LLM_CHECK_SQL))
def test_against_sql(spark, sf, con, name):
    df = LLM_QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    answer = con.execute(LLM_CHECK_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in answer.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in LLM_QUERIES["op5_suffix_dedup"](spark, sf).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain.repeats([r.text for r in rows]), strict=True))


def test_packing_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check_packed(rows, LLM_QUERIES["op3_packing"](spark, sf).collect(), 4096) > 0.95


@pytest.mark.parametrize("name", ["op4_token_counts", "op6_quality", "op7_html_extraction", "op10_license_scan"])
def test_covers_its_table(spark, sf, name):
    found = LLM_QUERIES[name](spark, sf)
    pages = name.startswith("op7")
    ids = {r[0] for r in spark.read.parquet(f"{sf}/{'pages' if pages else 'documents'}.parquet").select("page_id" if pages else "doc_id").collect()}
    got = {r[0] for r in found.select(found.columns[0]).collect()}
    assert got <= ids if name.startswith("op10") else got == ids


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    (_, keep_good), (_, cut_lines), (_, keep_one), (_, clean), (_, pack) = corpus_pipeline.STAGES

    def kept(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def rows_of(df):
        return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]

    good = kept(keep_good(spark, docs, sf), "1")
    assert good.schema == docs.schema
    assert {d for d, _ in rows_of(good)} == {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    lines = kept(cut_lines(spark, good, sf), "2")
    assert rows_of(lines) == [(d, t) for (d, _), (_, _, t) in zip(rows_of(good), plain.keep_lines(rows_of(good)), strict=True)]
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0
    one = kept(keep_one(spark, lines, sf), "3")
    group, _ = plain.similar_groups(rows_of(lines), 5, 4, 5)
    assert rows_of(one) == [r for r, g in zip(rows_of(lines), group, strict=True) if r[0] == g]
    uncontaminated = kept(clean(spark, one, sf), "4")
    leaks = {d for d, _ in plain.passages(rows_of(one), items)}
    assert leaks and rows_of(uncontaminated) == [r for r in rows_of(one) if r[0] not in leaks]
    assert uncontaminated.schema.names == docs.schema.names
    pieces = pack(spark, uncontaminated, sf).collect()
    check_packed(rows_of(uncontaminated), pieces, 4096)
    assert sum(p.length for p in corpus_pipeline.run(spark, sf).collect()) == sum(p.length for p in pieces)


def test_pipeline_stages_keep_clean_rows_of_repeated_ids(spark, sf):
    """Null and repeated ids link nothing; copies and contaminated rows go alone."""

    def own(k):
        return " ".join(f"w{k}x{i}" for i in range(60))

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, own(1)), (None, own(2)), (None, None), (7, own(3)), (7, own(4)), (7, own(4)), (8, own(4) + " more"), (9, own(5)), (None, own(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("key", F.lit("k")).repartition(3)
    one = corpus_pipeline.distinct_documents(spark, docs, sf)
    assert one.columns == docs.columns
    want = [(None, own(1)), (None, own(2)), (None, None), (7, own(3)), (7, own(4)), (None, own(5))]
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=str) == sorted(want, key=str)
    leaks = [(None, own(6) + " " + item), (7, item), (10, item)]
    mixed = docs.unionByName(spark.createDataFrame(leaks, "doc_id long, text string").withColumn("doc", F.lit(2)).withColumn("key", F.lit("l")))
    clean = corpus_pipeline.without_benchmark(spark, mixed, sf)
    assert clean.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(rows, key=str)
