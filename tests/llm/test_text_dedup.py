"""Line, exact, suffix and near deduplication against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import plain
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from gradeloom.llm.anchors import GRAM, SPREAD, WINDOW, ByteHash, anchor_rows
from gradeloom.llm.components import components
from gradeloom.session import Scratch, shared_dir


def line_results(df, **rule):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.kept_digests(df, **rule).collect())


def plain_lines(rows, **rule):
    found = zip(rows, plain.keep_lines(rows, **rule), strict=True)
    return Counter((doc, n, dropped, plain.sha(text)) for (doc, _), (n, dropped, text) in found)


def test_lines(docs_of, odd_rows):
    assert line_results(docs_of(odd_rows)) == plain_lines(odd_rows)


def test_lines_hot_key_over_partitions(docs_of, many_partitions):
    rng = random.Random(1)
    lines = [f"line {k} " + "x" * rng.randint(20, 60) for k in range(12)]
    rows = [(i, "\n".join(["the line that is in all documents of this table"] + rng.sample(lines, 3))) for i in range(120)]
    assert line_results(docs_of(rows)) == plain_lines(rows)
    assert line_results(docs_of(rows), min_docs=40) == plain_lines(rows, min_docs=40)


def test_lines_empty_table_and_dropping(docs_of, odd_rows):
    assert line_results(docs_of([])) == Counter()
    df = docs_of(odd_rows)
    out = line_dedup.drop_lines(df)
    assert out.schema.names == df.schema.names
    want = [None if t is None else k[2] for (_, t), k in zip(odd_rows, plain.keep_lines(odd_rows), strict=True)]
    got = Counter((r.doc_id, r.text, r["with.dot"], r.row) for r in out.collect())
    assert got == Counter((d, w, 6, "row") for (d, _), w in zip(odd_rows, want, strict=True))


def plain_exact(rows):
    """One row for each row; of repeated rows that stay, one is kept."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups["".join(c for c in text or "" if c not in plain.SPACE)].append((-len(text or ""), plain.number(doc), text or "", doc))
    out = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:2])
        for k, m in enumerate(sorted(members)):
            out[m[3], best[3], len(members), k == 0, plain.sha(norm)] += 1
    return out


@pytest.mark.parametrize("cut", ["doc % 2 = 0", "true", "false"])
def test_exact(docs_of, odd_rows, cut):
    rows = [r for r in odd_rows if r != (21, odd_rows[8][1])]  # an id twice in one group
    rows += [(1, "abc"), (1, "abc"), (2, "a bc"), (3, "ab\tc"), (3, "ab\tc"), (None, ""), (None, " "), (None, None), (50, "own"), (50, "own")]
    got = exact_dedup.resolve(docs_of(rows), F.expr(cut)).collect()
    assert Counter(tuple(r) for r in got) == plain_exact(rows)


def test_exact_large_group_and_empty(docs_of):
    rows = [(i, "copy  of one text" if i % 3 else f"own {i}") for i in range(2000)]
    got = exact_dedup.resolve(docs_of(rows), F.expr("doc < 900")).collect()
    assert Counter(tuple(r) for r in got) == plain_exact(rows)
    assert exact_dedup.resolve(docs_of([]), F.expr("true")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, np.uint64)
    built = exact_dedup.FuseFilter.build(np.concatenate((keys, keys[: n // 3])))
    assert built.contains(keys).all()
    assert built.contains(rng.integers(0, 2**64, 50_000, np.uint64)).mean() < 0.01


def suffix_results(df):
    found = suffix_dedup.cut_repeats(df).collect()
    return Counter((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), r.kept_sha256) for r in found)


def plain_repeats(rows):
    return Counter((d, *r) for (d, _), r in zip(rows, plain.repeats([t for _, t in rows]), strict=True))


def test_suffix(docs_of, odd_rows):
    assert suffix_results(docs_of(odd_rows)) == plain_repeats(odd_rows)
    assert suffix_results(docs_of([])) == Counter()


def test_suffix_boundaries_and_hot_passage(docs_of, many_partitions):
    rng = random.Random(2)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, line = noise(260), noise(150)
    rows = [(i, noise(rng.randint(0, 150)) + passage + noise(rng.randint(0, 99)) + line + noise(30)) for i in range(60)]
    for n in (199, 200, 201, 327, 328):
        text = noise(n)
        rows += [(100 + n, "é" + text + "1"), (500 + n, "è" + text + "2"), (900 + n, text * 2)]
    rows += [(1, "ab" * 400), (2, "ab" * 90), (3, "a" * 199), (4, "b" * 200)]
    assert suffix_results(docs_of(rows)) == plain_repeats(rows)


def test_suffix_long_text_in_segments(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(1, base), (2, base[:1500] + "X" + base[1400:2600]), (3, base[900:1230])]
    assert suffix_results(docs_of(rows)) == plain_repeats(rows)


def test_anchors_cover_every_window_once():
    rng = random.Random(4)
    parts = [b"ab" * 300, bytes(rng.choice(b"ab") for _ in range(700)), b"", bytes(rng.randrange(256) for _ in range(900)), b"x" * 200]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    gram = ByteHash(data).grams(GRAM)
    want = {}
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        for p in range(s, e - WINDOW + 1):
            want[p] = p + SPREAD - 1 - int(np.argmin(gram[p : p + SPREAD][::-1]))
    got = {}
    for _, anchor, first, last, *_ in zip(*anchor_rows(data, starts, ends), strict=True):
        for p in range(first, last + 1):
            assert p not in got
            got[p] = anchor
    assert got == want


def near_results(df, width, threshold):
    found = ngram_join.join_components(df, width, threshold).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in found)


def plain_near(rows, width, threshold):
    group, sets = plain.similar_groups(rows, width, *threshold)
    out = zip(rows, group, sets, strict=True)
    return Counter((d, len(s), None if g == plain.LOWEST else g) for (d, _), g, s in out)


@pytest.mark.parametrize(("width", "threshold"), [(5, (4, 5)), (4, (85, 100)), (1, (1, 2))])
def test_near(docs_of, odd_rows, width, threshold):
    assert near_results(docs_of(odd_rows), width, threshold) == plain_near(odd_rows, width, threshold)


def test_near_chain_star_and_parts(docs_of, monkeypatch, many_partitions):
    monkeypatch.setattr(ngram_join, "PART_DOCS", 10)
    monkeypatch.setattr(ngram_join, "PART_MAPS", 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # copies near the first, many of them not near each other
        copy = list(base)
        for k in rng.sample(range(120), rng.choice([1, 1, 2, 3])):
            copy[k] = f"e{i}"
        rows.append((i, " ".join(copy)))
    chain = [f"c{rng.randrange(10**6)}" for _ in range(100)]
    for i in range(15):
        chain[6 * i % 100] = f"d{i}"
        rows.append((100 + i, " ".join(chain)))
    rows += [(200 + n, " ".join(base[:n])) for n in range(1, 30)]
    df = docs_of(rows)
    for width, threshold in ((4, (85, 100)), (5, (4, 5))):
        assert near_results(df, width, threshold) == plain_near(rows, width, threshold)


def test_near_empty_and_keep_one(docs_of, odd_rows):
    assert near_results(docs_of([]), 5, (4, 5)) == Counter()
    df = docs_of(odd_rows)
    out = ngram_join.keep_one(df)
    assert out.schema.names == df.schema.names
    group, sets = plain.similar_groups(odd_rows, 5, 4, 5)
    want = Counter(d for d, s in zip(group, sets, strict=True) if s)
    kept = Counter(plain.number(r.doc_id) for r in out.collect() if plain.shingle_set(r.text, 5))
    assert kept == Counter(dict.fromkeys(want, 1))
    empty = {plain.number(d) for (d, _), s in zip(odd_rows, sets, strict=True) if not s}
    assert {plain.number(r.doc_id) for r in out.collect() if not plain.shingle_set(r.text, 5)} == empty


@pytest.mark.parametrize("threshold", [(85, 100), (4, 5), (1, 2), (95, 100)])
def test_similar_sets_share_a_key(threshold):
    keys = ngram_join.Keys(*threshold)
    above, below = threshold
    rng = np.random.default_rng(8)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.5 else int(rng.integers(1, 30))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        differing = keys.differing(len(a))
        drop = int(rng.integers(0, differing + 1))
        add = int(rng.integers(0, max(1, differing - drop + 1)))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, add, np.uint64))))
        common = len(np.intersect1d(a, b))
        if below * common >= above * (len(a) + len(b) - common) and len(b) and not (len(a) == len(b) == common):
            tried += 1
            assert len(np.intersect1d(keys.of(a), keys.of(b))), (len(a), len(b), common)
    assert tried > 300


@pytest.mark.parametrize("threshold", [(85, 100), (4, 5), (1, 2)])
def test_crowded_sets_share_a_key(threshold):
    """Sets whose shingles fall into very few groups, so that every group can differ."""
    keys = ngram_join.Keys(*threshold)
    above, below = threshold
    rng = np.random.default_rng(18)
    tried = 0
    for n in range(keys.base, 40):
        for n_groups in {g for _, g in keys.schemes(n)}:
            pool = rng.integers(0, 2**64, 200_000, np.uint64)
            group = ((ngram_join.mix(pool, 14) >> np.uint64(32)) * np.uint64(n_groups)) >> np.uint64(32)
            for few in (1, 2, 3):
                crowd = rng.permutation(pool[group < few])
                a = np.unique(crowd[:n])
                for drop in range(keys.differing(n) + 1):
                    add = keys.differing(n) - drop
                    b = np.unique(np.concatenate((rng.permutation(a)[drop:], crowd[n : n + add])))
                    common = len(np.intersect1d(a, b))
                    if below * common >= above * (len(a) + len(b) - common) and len(b):
                        tried += 1
                        assert len(np.intersect1d(keys.of(a), keys.of(b))), (len(a), len(b), common)
    assert tried > 100


def test_crowded_texts_are_linked(docs_of):
    text = "the old red w3 w14 w17 w22 w29 w35 w39 w44 w54 w64 w88 w94"
    got = ngram_join.join_components(docs_of([(1, text), (2, text + " w104 w125")]), width=4, threshold=(85, 100)).collect()
    assert sorted(map(tuple, got)) == [(1, 12, 1), (2, 14, 1)]


@pytest.mark.parametrize("spanning", [True, False])
def test_tree_finds_all_pairs(spanning):
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**64, int(rng.integers(1, 300)), np.uint64)
        for _ in range(int(rng.integers(1, 8))):
            mine = base[rng.random(len(base)) > 0.05 * rng.random()]
            sets.append(np.unique(np.concatenate((mine, rng.integers(0, 2**64, int(rng.integers(0, 6)), np.uint64)))))
    for left, right in ((sets, None), (sets[:70], sets[70:])):
        other = right if right is not None else left
        want = {
            (i, j)
            for i in range(len(left))
            for j in range(i + 1 if right is None else 0, len(other))
            if 100 * (c := len(np.intersect1d(left[i], other[j]))) >= 85 * (len(left[i]) + len(other[j]) - c)
        }
        got = {(p, q) if right is not None else (min(p, q), max(p, q)) for p, q, _ in ngram_join.similar_pairs(left, right, 85, 100, spanning)}
        assert got <= want
        if spanning:
            shift = 0 if right is None else len(left)
            assert plain.components(len(sets), [(i, j + shift) for i, j in got]).__len__() == len(sets)
            a = plain.components(len(sets), [(i, j + shift) for i, j in got])
            b = plain.components(len(sets), [(i, j + shift) for i, j in want])
            assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))
        else:
            assert got == want


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    df = spark.createDataFrame(links, "u long, v long").repartition(4)
    group = plain.components(1100, links)
    least = {}
    for v in range(1100):
        least.setdefault(group[v], v)
    got = {r.v: r.root for r in components(df).collect()}
    for v in range(1100):
        assert got.get(v, v) == least[group[v]]
    assert components(df.limit(0)).collect() == []


def test_repeats_are_found_in_small_pieces_of_a_batch():
    import pyarrow as pa

    from gradeloom.llm import suffix_dedup

    sizes = []

    def run(batches):
        for batch in batches:
            sizes.append(sum(map(len, batch["body"].to_pylist())))
            yield batch

    texts = ["x" * 500_000] * 10 + ["", "y" * 5_000_000]
    batch = pa.RecordBatch.from_pydict({"body": texts})
    out = list(suffix_dedup._bounded(run)(iter([batch, batch.slice(0, 0)])))
    assert [t for b in out for t in b["body"].to_pylist()] == texts
    assert max(sizes[:-1]) <= suffix_dedup.MOST_BYTES and sizes[-1] == 5_000_000


def test_a_wide_bitmap_leaves_narrow_ones_apart():
    rng = np.random.default_rng(21)
    sets = [np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in [1000] * 30 + [4000]]
    tree = ngram_join.SignatureTree([ngram_join.bitmap(s) for s in sets], [len(s) for s in sets])
    assert sum(len(x) for x, _ in ngram_join.traverse(tree, tree, 4, 5)) == 0
    near = [*sets, sets[3][50:], sets[-1][50:]]
    tree = ngram_join.SignatureTree([ngram_join.bitmap(s) for s in near], [len(s) for s in near])
    pairs = {tuple(sorted((int(tree.order[i]), int(tree.order[j])))) for x, y in ngram_join.traverse(tree, tree, 4, 5) for i, j in zip(x, y, strict=True)}
    assert pairs == {(3, 31), (30, 32)}


def test_connecting_pairs_are_kept_only():
    rng = np.random.default_rng(22)
    for n in (2, 50, 300):
        batches = [(rng.integers(0, n, 40), rng.integers(0, n, 40)) for _ in range(n // 20 + 1)]
        all_pairs = [pair for x, y in batches for pair in zip(x.tolist(), y.tolist(), strict=True)]
        kept = ngram_join._connected(iter(batches), n)
        want = plain.components(n, all_pairs)
        assert len(kept) == n - len(set(want)) and set(kept) <= set(all_pairs)
        assert len(set(zip(want, plain.components(n, kept), strict=True))) == len(set(want))


def test_a_set_travels_once_whatever_its_roots(docs_of, spark):
    """Documents of many roots: all pairs share words, but each root is the first document of other words."""
    rng = random.Random(23)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"e{i}" for w in base)) for i in range(30)]
    rows += [(100 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(400))) for i in range(10)]
    texts = docs_of(rows, clashing=False).select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    scratch = Scratch()
    found = scratch.cut(ngram_join.describe(texts, 5, ngram_join.Keys(4, 5)))

    def reps(*columns):
        return found.groupBy("s1", "s2", "n").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in columns if c != "n"])

    assert ngram_join.meeting(reps("keys"), scratch).count() > 60
    groups = ngram_join.possible(reps, 4, 5, scratch)
    assert sorted(map(tuple, groups.select("root", "doc").collect())) == [(0, i) for i in range(30)]
    scratch.drop()


def test_empty_texts_of_an_id_link_nothing(docs_of):
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    other = [w if i % 60 else f"e{i}" for i, w in enumerate(base)][:-12]
    rows = [(1, " ".join(base)), (1, ""), (2, " ".join(other)), (2, ""), (2, " \n")]
    assert near_results(docs_of(rows), 5, (85, 100)) == plain_near(rows, 5, (85, 100))
    assert {r[2] for r in near_results(docs_of(rows), 5, (85, 100))} == {1, 2}


def files_below(folder, pattern):
    return {p for p in Path(folder).rglob(pattern) if p.is_file()}


def test_the_join_leaves_no_keys_bitmaps_and_shuffle_files(docs_of, odd_rows, spark):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    df = docs_of(odd_rows)
    before = files_below(shared, "*.parquet")
    ngram_join.join_components(df).collect()
    names = {c for p in files_below(shared, "*.parquet") - before for c in pq.read_schema(p).names}
    assert "doc" in names and not names & {"keys", "map", "kind", "part"}

    (local,) = [spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString()]
    scratch = Scratch()
    was = [files_below(d, "shuffle_*.data") for d in local]
    rows = scratch.cut(df.repartition(7, "doc_id"))
    assert [files_below(d, "shuffle_*.data") - w for d, w in zip(local, was, strict=True)] == [set()] * len(local)
    assert rows.count() == len(odd_rows)
    ((_, path),) = scratch.paths
    assert files_below(path.removeprefix("file:"), "*.parquet")
    scratch.drop()
    assert not Path(path.removeprefix("file:")).exists()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_texts_meet_many_places_by_a_shuffle(docs_of, odd_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_DOCS", 0)
    assert near_results(docs_of(odd_rows), 5, (4, 5)) == plain_near(odd_rows, 5, (4, 5))
