"""Periodic runs, ranked search and groups of vectors against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest

from gradeloom.llm import embedding_groups, periodic_runs, queries, term_ranking

# --- periodic runs --------------------------------------------------------------------


def plain_runs(words):
    """(start, length, period) of all runs, by comparing each period at each place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i + q - start >= max(6, 4 * q):
                    found.setdefault((start, i + q - start), q)
                start = i + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts():
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "x", "a a a a a", "a a a a a a", "é é é é é é é", "A a A a A a A a", "a b a b a b", "a b " * 4]
    texts += ["a a a a a a b " * 5, "a a b a a b a a b a a b a a", "a\xa0b " * 9, " ".join("abcabcab" * 9)]
    for _ in range(300):
        letters = "abcd"[: rng.randint(1, 4)]
        words = [rng.choice(letters) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            part = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(words))
            words[at:at] = (part * 9)[: rng.randint(0, 80)]
        texts.append(rng.choice([" ", "  ", "\n\t"]).join(words))
    long = [f"w{rng.randint(0, 500)}" for _ in range(3000)]
    texts.append(" ".join(long + long[-700:] * 4 + long[:300]))
    texts.append(" ".join(long[:999] * 4))
    return texts


def test_runs(docs_of):
    texts = periodic_texts()
    rows = [(i % 7 or None, t) for i, t in enumerate(texts)] + [(1, "a b " * 4)] * 2
    found = periodic_runs.find_runs(docs_of(rows, partitions=3))
    assert found.columns == ["doc_id", "n_words", "runs", "text"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in found.collect()]
    want = []
    for doc, text in rows:
        words = split(text)
        runs = plain_runs(words)
        want.append((doc, len(words), runs, plain_collapsed(words, runs)))
    assert sum(len(w[2]) for w in want) > 300
    assert sorted(got, key=str) == sorted(want, key=str)


def test_runs_of_an_empty_table(docs_of):
    assert periodic_runs.find_runs(docs_of([])).collect() == []


def test_catchers_work_online():
    """Words that come one by one give the squares of all at once, each as its last word comes."""
    rng = np.random.default_rng(4)
    words = np.concatenate((rng.integers(0, 3, 90), np.tile(rng.integers(0, 9, 17), 6), rng.integers(0, 2, 40)))
    whole = periodic_runs.SquareCatchers(len(words) // 4)
    want = set(zip(*(x.tolist() for x in whole.append(words)), strict=True))
    online = periodic_runs.SquareCatchers(len(words) // 4)
    got = set()
    for i in range(len(words)):
        for at, period in zip(*(x.tolist() for x in online.append(words[i : i + 1])), strict=True):
            size = 1 << (period.bit_length() - 1)
            assert at + size == i + 1 and (words[at : at + size] == words[at - period : at - period + size]).all()
            got.add((at, period))
    assert got == want
    assert online.runs().tolist() == whole.runs().tolist() == [list(r) for r in plain_runs(words.tolist())]


def test_runs_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_periodic_runs(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    for doc, text in rows:
        words, h = split(text), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        if len(words) > 4000:
            continue
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        assert got[doc] == (len(runs), *top, plain.sha(listed), plain.sha(plain_collapsed(words, runs))), doc


def test_planted_runs_of_odd_rows(docs_of):
    rows = [(None, "a b"), (None, None), *((i, None if i % 3 == 0 else " ") for i in range(60))]
    assert sorted(map(tuple, queries.with_planted_runs(docs_of(rows)).collect()), key=str) == sorted(rows, key=str)


# --- ranked search --------------------------------------------------------------------


def terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def plain_search(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, some in wanted.items():
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * len(counts) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in some
                if t in c
            )
            if score > 0:
                scored.append((-score, plain.number(doc), doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def items_of(spark):
    def build(rows):
        full = [(i, t, 1, 2, "x") for i, t in rows]
        return spark.createDataFrame(full, "item_id long, text string, doc long, term int, body string")

    return build


def search_rows(odd_rows):
    rng = random.Random(9)
    small = [(100 + i % 50, " ".join(rng.choice(["ab", "Ab", "abc", "b", "é", "éa", "0", "x-y", "ab_c", "\x7fb", "\x00ab"]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    items = [(1, "ab abc; B"), (2, None), (3, "éa É é"), (3, "0"), (None, "x y"), (5, "..."), (6, "AB ab aB"), (7, odd_rows[6][1][:300]), (8, "be")]
    return odd_rows + small, items


@pytest.mark.parametrize("scan_chars", [1_000_000, 40])
def test_search(docs_of, items_of, odd_rows, many_partitions, scan_chars):
    docs, items = search_rows(odd_rows)
    found = term_ranking.search(docs_of(docs), items_of(items), top=5, scan_chars=scan_chars)
    assert ranked(found) == plain_search(docs, items, 5)


def test_search_without_rows(docs_of, items_of):
    assert term_ranking.search(docs_of([]), items_of([(1, "a")])).collect() == []
    assert term_ranking.search(docs_of([(1, "a")]), items_of([])).collect() == []
    assert term_ranking.search(docs_of([(1, None), (2, ".")]), items_of([(1, "a")])).collect() == []


def test_scan_cuts_long_texts_between_terms(monkeypatch):
    monkeypatch.setattr(term_ranking, "PIECE", 10)
    text = "ab abcdefghijklmnop ab, ab ab" * 20
    found = term_ranking.automaton(["ab", "abcdefghijklmnop"])
    seen = term_ranking.seen(text.encode())
    assert {0: sum(t == "ab" for t in terms(text)), 1: 20} == dict(term_ranking.matches(found, seen))
    assert term_ranking.count_terms(seen) == len(terms(text))


def test_best_keeps_ties_of_smaller_documents():
    rng = np.random.default_rng(1)
    item, score, doc = rng.integers(0, 4, 5000), rng.integers(0, 30, 5000), rng.permutation(5000)
    best = term_ranking.Best(4, 7)
    for i in range(0, 5000, 100):
        best.add(item[i : i + 100], score[i : i + 100], doc[i : i + 100])
        if i % 700 == 0:
            best.cut()
    got = [tuple(r) for r in best.cut().T.tolist()]
    rows = sorted(zip(item.tolist(), (-score).tolist(), doc.tolist(), strict=True))
    want = [r for k in range(4) for r in [x for x in rows if x[0] == k][:7]]
    assert got == [(i, -s, d) for i, s, d in want]


# --- groups of vectors ----------------------------------------------------------------


def plain_groups(rows, threshold):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    units = [None] * len(rows)
    for i, (_, v) in enumerate(rows):
        if usable(v):
            x = np.array(v, float) / np.abs(v).max()
            units[i] = x / math.sqrt(x @ x)
    links = []
    for i, x in enumerate(units):
        links += [(i, j) for j in range(i) if x is not None and units[j] is not None and len(x) == len(units[j]) and x @ units[j] >= threshold]
    degree = Counter(i for link in links for i in link)
    group = plain.components(len(rows), links)
    least = {}
    for g, (vec_id, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, 2**63), plain.number(vec_id))
    out = []
    for i, (g, (vec_id, _)) in enumerate(zip(group, rows, strict=True)):
        root = None if least[g] == plain.LOWEST else least[g]
        out.append((vec_id, degree[i], root, vec_id == root))
    return sorted(out, key=str)


def vector_rows(seed=0, dim=24, n=400):
    rng = np.random.default_rng(seed)

    def near(v, cosine):
        w = rng.normal(size=dim)
        w -= w @ v / (v @ v) * v
        return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)

    base = [rng.normal(size=dim) for _ in range(n)]
    vectors = list(base)
    vectors += [near(base[i], c) * 3 for i, c in enumerate(np.linspace(0.86, 0.95, 150))]
    chain = base[0]
    for _ in range(12):
        chain = near(chain, 0.92)
        vectors.append(chain)
    vectors += [near(base[1], rng.uniform(0.93, 0.999)) for _ in range(250)]  # a large group of near copies
    vectors += [near(base[2], 0.99) for _ in range(120)]
    vectors += [base[3]] * 9 + [base[3] * 1e-200, base[3] * 1e200]
    rows = [(int(k), v.tolist()) for k, v in zip(rng.permutation(5 * len(vectors)), vectors, strict=False)]
    zero = [0.0] * dim
    rows += [(-1, None), (-2, []), (-3, zero), (-4, zero), (-5, [None, *zero[1:]]), (-6, [math.nan, *zero[1:]]), (-7, [math.inf] * dim)]
    rows += [(-8, [1.0, 2.0]), (-9, [2.0, 4.0]), (-10, [1.0, -2.0]), (-8, [1.0, 2.1]), (-11, [0.0, 1.0]), (-12, [-0.0, 1.0])]
    rows += [(None, base[5].tolist()), (None, None), (None, (-base[5]).tolist()), rows[0], rows[0], (rows[0][0], base[9].tolist())]
    return rows


def grouped(spark, rows, kind="double", **how):
    full = [(i, v, 1, 2, 3, "x") for i, v in rows]
    df = spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, key int, cell int, links int, label string")
    found = embedding_groups.near_copies(df.repartition(4), **how)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return [tuple(r) for r in found.collect()]


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_groups_of_vectors(spark, many_partitions, monkeypatch, threshold):
    monkeypatch.setattr(embedding_groups, "BLOCK_NUMBERS", 24 * 60)  # several parts in a cell, balls in parts of their own
    monkeypatch.setattr(embedding_groups, "TILE", 32)
    rows = vector_rows()
    got = grouped(spark, rows, threshold=threshold, spread=None)
    assert [(i, n, c, bool(k)) for i, n, c, k in sorted(got, key=str)] == [
        (i, n, c, bool(k)) for i, n, c, k in plain_groups(rows, threshold)
    ]


def test_groups_of_float_vectors(spark):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vector_rows(1, n=150)]
    rows = [r for r in rows if r[1] is None or all(x is None or not math.isfinite(x) or x == 0 or 1e-30 < abs(x) < 1e30 for x in r[1])]
    got = grouped(spark, rows, "float")
    assert [(i, n, c, bool(k)) for i, n, c, k in sorted(got, key=str)] == [(i, n, c, bool(k)) for i, n, c, k in plain_groups(rows, 0.9)]


def test_groups_without_vectors(spark):
    assert grouped(spark, []) == []
    assert sorted(grouped(spark, [(1, None), (2, [0.0]), (None, [])]), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_pivots_are_found():
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    sample = embedding_groups.unit(np.vstack((rng.normal(size=(500, 32)), base / np.linalg.norm(base) + 0.01 * rng.normal(size=(100, 32)))))
    pivots = embedding_groups.fit_pivots(sample, embedding_groups.fit_centres(sample, 5), 0.97, 50)
    assert len(pivots) == 1 and (sample[500:] @ pivots[0] > 0.97).all()


def test_recall_of_random_differences(spark):
    """Pairs exactly at the threshold in 64 dimensions, far more cells than the rows ask for."""
    rng = np.random.default_rng(5)
    a = embedding_groups.unit(rng.normal(size=(4000, 64)))
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    b = 0.9001 * a + math.sqrt(1 - 0.9001**2) * embedding_groups.unit(w)
    layout = embedding_groups.Layout(embedding_groups.fit_centres(np.vstack((a, b)), 100), np.zeros((0, 64)), 0.9, 4.0)
    (home_a, cells_a, _), (home_b, cells_b, _) = layout.place(a), layout.place(b)
    met = [home_b[i] in cells_a[i] or home_a[i] in cells_b[i] for i in range(len(a))]
    assert np.mean(met) >= 0.999
    assert np.mean([len(c) for c in cells_a]) < 25
    exact = embedding_groups.Layout(layout.centres, layout.pivots, 0.9, None)
    (home_a, cells_a, _), (home_b, cells_b, _) = exact.place(a), exact.place(b)
    assert all(home_b[i] in cells_a[i] or home_a[i] in cells_b[i] for i in range(len(a)))

