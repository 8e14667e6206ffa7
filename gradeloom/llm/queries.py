"""The registered queries of the text operators and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import (
    decontaminate,
    embedding_groups,
    exact_dedup,
    html_text,
    licences,
    line_dedup,
    ngram_join,
    packing,
    periodic_runs,
    quality,
    suffix_dedup,
    term_ranking,
    token_counts,
)
from gradeloom.llm.common import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_CHECK_SQL[name] = sql.strip()
        return fn

    return register


# White space [\x20\x09-\x0D] as a DuckDB text.
SQL_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op1_line_dedup",
    f"""
    WITH split AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), lines AS (
        SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM split
    ), keyed AS (
        SELECT *, translate(trim(line, {SQL_SPACES}), {SQL_UPPER_LOWER}) AS key FROM lines
    ), common AS (
        SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
        SELECT k.*, coalesce(k.doc_id < c.top, false) AS dropped FROM keyed k LEFT JOIN common c USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op1_line_dedup(spark, sf_dir):
    return line_dedup.kept_digests(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


@query(
    "op2_exact_dedup",
    f"""
    WITH rows AS (
        SELECT doc_id, length(coalesce(text, '')) AS n_chars,
            sha256(translate(coalesce(text, ''), {SQL_SPACES}, '')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
        count(*) OVER (PARTITION BY text_sha256) AS group_size,
        row_number() OVER best = 1 AS kept, text_sha256
    FROM rows WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
    """,
)
def op2_exact_dedup(spark, sf_dir):
    """Every document, half of them as the snapshot and half as the new batch."""
    in_snapshot = F.pmod(F.xxhash64("doc"), F.lit(2)) == 0
    return exact_dedup.resolve(table(spark, sf_dir, "documents"), in_snapshot)


def public(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"), size=4096)


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    """Tokens of source, language and each line of the text of every document."""
    from public_tokenizers import PATTERN

    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public("byte_bpe_50k.tiktoken"), PATTERN, ["source", "lang", "text"])


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    n_spans = F.size("spans").cast("long")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans.alias("n_spans"), "kept_sha256")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@query("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+')"


@query(
    "op8_decontamination",
    f"""
    WITH item AS (
        SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k
        FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0
    ), item_shingle AS (
        SELECT item_id, n, k, i, w[i : i + k - 1] AS s
        FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM item)
    ), doc AS (
        SELECT doc_id, {WORDS_SQL} AS w FROM documents
    ), doc_shingle AS (
        SELECT doc_id, k, i, w[i : i + k - 1] AS s
        FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc d, (SELECT DISTINCT k FROM item))
    ), pair AS (
        SELECT DISTINCT doc_id, item_id, n, k FROM doc_shingle JOIN item_shingle USING (k, s)
    ), aligned AS (
        SELECT p.*, unnest(range(0, greatest(len(w) - n, 0) + 1)) AS start FROM pair p JOIN doc USING (doc_id)
    ), pair_shingle AS (
        SELECT a.doc_id, item_id, n, start, w[j : j + least(k, len(part)) - 1] AS s FROM (
            SELECT a.*, d.w[start + 1 : start + n] AS part, d.w,
                unnest(range(start + 1, start + greatest(least(n, len(d.w)) - k, 0) + 2)) AS j
            FROM aligned a JOIN doc d USING (doc_id)
        ) a
    ), weight AS (
        SELECT doc_id, item_id, n, start, s, count(*) AS c FROM pair_shingle GROUP BY ALL
    ), item_weight AS (
        SELECT item_id, s, count(*) AS c FROM item_shingle GROUP BY ALL
    ), size AS (
        SELECT doc_id, item_id, n, start, sum(c) AS total FROM weight GROUP BY ALL
    ), shared AS (
        SELECT doc_id, item_id, n, start, sum(least(w.c, i.c)) AS common
        FROM weight w JOIN item_weight i USING (item_id, s) GROUP BY ALL
    ), scored AS (
        SELECT doc_id, item_id, n, start, common, total + n - least(n, 5) + 1 - common AS either
        FROM shared JOIN size USING (doc_id, item_id, n, start)
    )
    SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words,
        CAST(common AS DOUBLE) / CAST(either AS DOUBLE) AS similarity
    FROM scored WHERE common * 5 >= either * 4
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / either DESC, start) = 1
    """,
)
def op8_decontamination(spark, sf_dir):
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


@query(
    "op9_ngram_jaccard",
    f"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {SQL_UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), shingle AS MATERIALIZED (
        SELECT DISTINCT doc_id, hash(w[i : i + 3]) AS s
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
    ), size AS MATERIALIZED (
        SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM shingle a JOIN shingle b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL
    ), link AS (
        SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
        WHERE 100 * common >= 85 * (x.n + y.n - common)
    ), edge AS MATERIALIZED (
        SELECT a, b FROM link UNION ALL SELECT b, a FROM link
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM doc
        UNION
        SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)
    """,
)
def op9_ngram_jaccard(spark, sf_dir):
    return ngram_join.join_components(table(spark, sf_dir, "documents"), width=4, threshold=(85, 100))


@query("op10_license_scan")
def op10_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"), anywhere=True)


@query(
    "op11_embedding_groups",
    """
    WITH RECURSIVE vec AS MATERIALIZED (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
            coalesce(len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
                AND list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])]) > 0, false) AS usable
        FROM embeddings
    ), link AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND a.usable AND b.usable
        WHERE list_cosine_similarity(a.v, b.v) >= 0.9
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM vec
        UNION
        SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
    ), component AS (
        SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
    )
    SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
    FROM component
    """,
)
def op11_embedding_groups(spark, sf_dir):
    return embedding_groups.near_copies(table(spark, sf_dir, "embeddings"), threshold=0.9)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which about a tenth, by a hash of the id, turn periodic at some word."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(repeated, F.lit(1), n - a)), " ")
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), periodic).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "runs", "text", best.alias("best"), listed.alias("listed")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


TERMS_SQL = rf"regexp_extract_all(translate(text, {SQL_UPPER_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_term_ranking",
    f"""
    WITH term AS (
        SELECT doc_id, unnest({TERMS_SQL}) AS t FROM documents
    ), tf AS MATERIALIZED (
        SELECT doc_id, t, count(*) AS tf FROM term GROUP BY ALL
    ), doc AS MATERIALIZED (
        SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
    ), total AS (
        SELECT count(*) AS N_docs, CAST(sum(n) AS BIGINT) AS L FROM doc
    ), weight AS (
        SELECT t, CAST(floor(1000 * ln(CAST(2 * N_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, total GROUP BY t, N_docs
    ), item AS (
        SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({TERMS_SQL}) AS t FROM benchmark)
    ), scored AS (
        SELECT item_id, doc_id,
            CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * N_docs) // L)))) AS BIGINT) AS score
        FROM item JOIN tf USING (t) JOIN weight USING (t) JOIN doc USING (doc_id), total
        GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
    """,
)
def op13_term_ranking(spark, sf_dir):
    return term_ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)
