"""Packing, token counts, quality, pages, decontamination and licences."""

from __future__ import annotations

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeloom.llm import decontaminate, html_text, licences, packing, quality, token_counts
from gradeloom.llm.word_tokens import WordEncoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_packed(rows, pieces, size, with_ids=False):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {}
    for doc, text in rows:
        ids[doc] = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == ids.keys()
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            part = ids[doc][p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids[doc]) and len(part) == p.length > 0
            assert p.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
            assert not with_ids or p.ids == part.tolist()
            at += p.length
        assert at == len(ids[doc])
    filled = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        filled += at
    return filled / (len(by_sequence) * size)


def test_packing(docs_of, odd_rows):
    rows = list({d: (d, t) for d, t in odd_rows}.values())
    check_packed(rows, packing.pack(docs_of(rows), WORD_BPE, size=512, with_ids=True).collect(), 512, True)
    long = [(i, "word " * (37 * i)) for i in range(200)]
    assert check_packed(long, packing.pack(docs_of(long, 8), WORD_BPE, size=256, windows=4).collect(), 256) > 0.98
    assert packing.pack(docs_of([]), WORD_BPE).collect() == []


def test_packing_repeated_rows(docs_of):
    pieces = packing.pack(docs_of([(1, "a b c")] * 5), WORD_BPE, size=8).collect()
    assert sum(p.length for p in pieces) == 20 and {p.doc_tokens for p in pieces} == {4}


def test_windows_are_bounded():
    rng = random.Random(1)
    state = packing.Windows(100, 5, 0)
    for doc in range(500):
        state.add(doc, np.zeros(rng.randint(1, 260), np.uint32))
        assert len(state.open) <= 5
    state.finish()
    filled = Counter()
    for p in state.pieces:
        filled[p[5]] += p[2]
    assert sum(n < 100 for n in filled.values()) <= 1 and max(filled.values()) == 100


def test_word_encoder_equals_tokenizer():
    encoder, rng = WordEncoder(WORD_BPE), random.Random(2)
    parts = ["a", "B", "é", "İ", "ς", ".", ",", "..", "'s", "'LL", "!", "1", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", " "]
    parts += ["<|endoftext|>", "<|", "漢", "\U0001f600", "é", "‍", "ﬁ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    ids, at = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def plain_counts(rows, fields, rule):
    """Token spans of another library, given to sections by their bytes."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    out = Counter()
    for doc, *values in rows:
        pieces, names = [], []
        for i, (field, value) in enumerate(zip(fields, values, strict=True)):
            lines = (value or "").split("\n") if field == "text" else [value or ""]
            for k, line in enumerate(lines):
                last = k + 1 == len(lines)
                pieces.append(line + ("\n" if not last or i + 1 < len(fields) else ""))
                names.append((field, k))
        text = "".join(pieces)
        owner = [s for s, p in enumerate(pieces) for _ in p.encode()]
        counts, crossing = Counter(), Counter()
        at = 0
        tokens = tokenizer.encode(text, add_special_tokens=False).ids
        for token in tokens:
            size = token_size(tokenizer, token)
            held = Counter(owner[at : at + size])
            to = {"first": owner[at], "last": owner[at + size - 1], "most": min(held, key=lambda s: (-held[s], s))}[rule]
            counts[to] += 1
            crossing[to] += len(held) > 1
            at += size
        assert at == len(text.encode())
        start = 0
        for s, (name, piece) in enumerate(zip(names, pieces, strict=True)):
            out[(doc, *name, start, start + len(piece), counts[s], crossing[s], len(tokens))] += 1
            start += len(piece)
    return out


def token_size(tokenizer, token):
    """Each character of a byte-level token stands for one byte."""
    return len(tokenizer.id_to_token(token))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, odd_rows, rule):
    rows = [(d, "en\n" if d else None, t) for d, t in odd_rows] + [(99, "\n\n", "\n\n\n  \n\r\n\n<|endoftext|>\n\n"), (98, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("doc", F.lit("x")).repartition(3)
    found = token_counts.count_tokens(df, BYTE_RANKS, public_tokenizers.PATTERN, ["lang", "text"], rule=rule)
    assert Counter(tuple(r) for r in found.collect()) == plain_counts(rows, ["lang", "text"], rule)
    none = token_counts.count_tokens(df.limit(0), BYTE_RANKS, public_tokenizers.PATTERN, ["lang", "text"])
    assert none.collect() == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.99
    assert np.mean([s >= 0.3 for s in good]) > 0.99
    assert quality.keep_good(docs, labels).count() == quality.classify(docs, labels).where("predicted = 1").count()


def test_quality_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    df = docs_of(odd_rows)
    found = quality.classify(df, labels).collect()
    assert len(found) == len(odd_rows) and {r.score for r in found} == {0.5}
    assert quality.classify(df.limit(0), labels).collect() == []
    some = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    scored = quality.classify(df, some).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    kept = quality.keep_good(df, some)
    assert kept.schema == df.schema and kept.count() == sum(r.predicted for r in scored)


def test_word_vectors_are_sums_over_all_neighbours(spark, docs_of):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 2, 3, 60]))) for _ in range(50)] + [None, "w1", "w1"]
    rows = docs_of(list(enumerate(texts))).select(F.coalesce("text", F.lit("")).alias("body"))
    places, signs = quality.index_vectors()
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    hasher = quality.WordHasher(quality.BUCKETS)
    for text in texts:
        words, _ = hasher.encode(pa.array([text or ""]))
        for i, word in enumerate(words):
            for j in range(max(0, i - quality.REACH), min(len(words), i + quality.REACH + 1)):
                if j != i:
                    for place, sign in zip(places[words[j]], signs[words[j]]):
                        sums[word, place] += sign
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    want = sums / np.where(length > 0, length, 1)
    assert (length > 0).sum() >= 30
    np.testing.assert_allclose(quality.word_vectors(rows.repartition(5)), want, atol=1e-6)


def test_kept_rows_are_those_predicted(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    for sample_rows in (quality.SAMPLE_ROWS, 40):  # all labels, and a draw of them
        scored = quality.classify(docs, labels, sample_rows=sample_rows)
        kept = quality.keep_good(docs, labels, sample_rows=sample_rows)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scored.collect() if r.predicted)


def test_pooling_and_fit():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    words, starts = np.array([1, 2, 3, 3, 9]), np.array([0, 0, 3, 5, 5])
    pooled = quality.pool(words, starts, vectors)
    d = quality.DIMENSIONS
    assert not pooled[0].any() and not pooled[3].any()
    np.testing.assert_allclose(pooled[1, :d], vectors[[1, 2, 3]].mean(axis=0), rtol=1e-5)
    np.testing.assert_allclose(pooled[1, d : 2 * d], vectors[[1, 2, 3]].std(axis=0), rtol=1e-3, atol=1e-4)
    np.testing.assert_allclose(pooled[2, 2 * d : -1], abs(vectors[9] - vectors[3]), rtol=1e-5)
    assert quality.fit(pooled, np.ones(4)).score(pooled).tolist() == [5 / 6] * 4


HTML = [
    ("", ""),
    ("plain <b>te</b>xt &amp; more &lt;", "plain text & more <"),
    ("<title>t</title><p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<p>a<div>b</div>c</p>d", "a\n\nb\nc\n\nd"),
    ("<ul><li>x<li>y<ol start=9><li>in<li>on</ol></ul>z", "- x\n- y\n  9. in\n  10. on\n\nz"),
    ("<table><tr><th>h<th>long head<tr><td>cell 1<td>c</table>", "h      | long head\ncell 1 | c"),
    ("<table><tr><td colspan=2>w<tr><td>a<td>b</table>t", "w\na | b\n\nt"),
    ("<table><tr><td><table><tr><td>i<td>j</table><td>k</table>", "i | j | k"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("a<script>var x='</p>';</script><style>p{}</style><!-- c --><noscript>n</noscript>", "an"),
    ("<p hidden>no<p style='color:red; display : none'>no</p><p>yes<span style='visibility:hidden'>no</span>", "yes"),
    ("<dl><dt>term<dd>what</dl><blockquote>q</blockquote>", "term\n  what\n\n  q"),
    ("<head><title>x</title>body <b>text", "body text"),
    ("</p></table></b>text<td>x</td>", "text x"),
    ("a &am", "a &am"),
    ("cut off <a href='", "cut off"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span><p>no</div>", "yes"),
    ("<div style='display:none'>no<span style='visibility:visible;display:block'>no</span></div>x", "x"),
    ("<p style='visibility:hidden !important; visibility:visible'>no<p style='display:none;display:block'>yes", "yes"),
    ("<ol reversed><li>a<li hidden>no<li>b</ol><ol><li value=7>c<li>d</ol>", "2. a\n1. b\n\n7. c\n8. d"),
    ("<ul style='visibility:hidden'><li>no<li><b style='visibility:visible'>yes</ul>", "  yes"),
    ("<table><tr><td>a<td style='visibility:hidden'>no<td>c<tr style='visibility:collapse'><td>no</table>", "a |  | c"),
    ("<table><tr><td>a</tr><td>b<td>c</table>", "a\nb | c"),
    ("<select><option>a<option>b</select><input value=v><input type=hidden value=w>", "a\nb\nv"),
]


@pytest.mark.parametrize(("html", "text"), HTML)
def test_page_text(html, text):
    assert html_text.page_text(html) == text


FOREIGN = [
    ('<p>Icon <svg class="i"/> all this text</p>after', "Icon all this text\n\nafter"),
    ("a <math/> b<svg><path d='x'/><g/></svg> c", "a b c"),
    ("<svg><title>t</title>no<text>one</text><text>two<tspan>s</tspan></text><defs><text>no</text></defs></svg> z", "one twos z"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>out", "in\n\nout"),
    ("let <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><annotation>no</annotation></math> be", "let x=2 be"),
    ("<svg><g><p>broken out</p>next", "broken out\n\nnext"),
    ("<div/>x<span/>y", "xy"),
]


@pytest.mark.parametrize(("html", "text"), FOREIGN)
def test_svg_and_math(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("opening", ["<div>", "<font>", "<span>", "<blockquote>", "<table><tr><td>"])
def test_deep_pages(opening):
    inner = "<script>var x</script><style>p{}</style><p hidden>no</p><ul><li>a<li>b</ul><pre>c\n  d</pre><table><tr><td>e<td>f</table>g"
    got = [line.strip() for line in html_text.page_text(opening * 3000 + inner).split("\n") if line]
    assert got == ["- a", "- b", "c", "d", "e | f", "g"]
    assert html_text.page_text("<div><b>" + "<i>" * 300 + "<u>x</u></i></i>" + "</i>" * 298 + "</b>y</div>z") == "xy\nz"


def test_many_nested_tables():
    for cell in ("<table><tr><td>x", "<table><tr><td>x<td>y", "<table><caption>x<tr><td>y<td><ul><li>"):
        began = time.monotonic()
        text = html_text.page_text(cell * 10_000)
        assert time.monotonic() - began < 5
        assert text.count("x") == 10_000 and len(text) < 20_000_000


def shown_words(node, seen=True):
    """Words of a made-up tree that are on the page, by the rules of its own attributes alone."""
    tag, rule, inside = node
    if rule in ("hidden", "style='display:none'"):
        return []
    seen = {"style='visibility:hidden'": False, "style='visibility:visible'": True}.get(rule, seen)
    return [w for part in inside for w in (([part] if seen else []) if isinstance(part, str) else shown_words(part, seen))]


def markup(node):
    tag, rule, inside = node
    return f"<{tag} {rule}>" + " ".join(p if isinstance(p, str) else markup(p) for p in inside) + f"</{tag}>"


def test_visible_words_of_any_tree():
    rng = random.Random(8)
    rules = ["", "", "", "hidden", "style='display:none'", "style='visibility:hidden'", "style='visibility:visible'", "style='visibility:inherit'"]
    inner = {"ul": ["li"], "ol": ["li"], "table": ["tr"], "tr": ["td", "th"]}

    def tree(tag, depth, tables):
        free = ["div", "span", "section", "blockquote", "ul", "ol", "b"] + (["table"] if tables else [])
        n = rng.randrange(4) if depth else 0
        kids = [tree(rng.choice(inner.get(tag, free)), depth - 1, tables) for _ in range(n)]
        if tag not in inner:
            kids += [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(3))]
            rng.shuffle(kids)
        return tag, rng.choice(rules), kids

    for k in range(400):
        page = tree("div", 7, tables=k % 2 == 1)
        got = re.findall(r"w[0-9]+", html_text.page_text(markup(page)))
        want = shown_words(page)
        # Lines of cells stand beside each other, so only their words are compared.
        assert (Counter(got) == Counter(want)) if k % 2 else (got == want)


def test_pages(spark):
    rows = [(i, h) for i, (h, _) in enumerate(HTML)] + [(None, None), (7, HTML[7][0]), (99, "<div>" * 5000 + "deep" + "</p>" * 50)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("doc", F.lit(1)).withColumn("text", F.lit("x"))
    got = Counter((r.page_id, r.text) for r in html_text.extract(df.repartition(3)).collect())
    want = Counter({(i, t): 1 for i, (_, t) in enumerate(HTML)}) + Counter([(None, ""), (7, HTML[7][1]), (99, "deep")])
    assert got == want
    assert html_text.extract(df.limit(0)).collect() == []


def test_no_markup_fails():
    rng = random.Random(3)
    bits = ["<div>", "</div>", "<table>", "<tr>", "<td>", "x ", "</p>", "<p>", "<li>", "</ul>", "<ul>", "&am", "<", ">", "<!--", "</table>", "<br>"]
    for _ in range(200):
        html_text.page_text("".join(rng.choice(bits) for _ in range(300)))


def test_passages(spark, docs_of, odd_rows):
    rng = random.Random(4)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    items = [(i, prose(n)) for i, n in enumerate([1, 3, 5, 8, 15, 30, 40, 60, 60, 120])]
    items.append((50, ["again"] * 12 + prose(20)))
    rows = [r for r in odd_rows if r[0] not in (20, 21, None)]
    for k, (i, words) in enumerate(items):
        for j, change in enumerate(("none", "one", "gap", "several", "half")):
            w = list(words)
            if change == "one":
                w[len(w) // 2] = "other"
            elif change == "gap":
                w.insert(len(w) // 3, "new")
            elif change == "several":
                for p in range(0, len(w), 9):
                    w[p] = "other"
            elif change == "half":
                w = w[: len(w) // 2]
            around = prose(rng.randint(0, 30)) if j else []
            rows.append((1000 + 10 * k + j, "  ".join([*around, *w, *prose(rng.randint(0, 20))]).upper()))
    items = [(i, " ".join(w)) for i, w in items] + [(None, "null item id here and so on"), (77, None), (78, " \n"), (3, " ".join(items[3][1]))]
    rows.append((5000, "x null item id\nhere and so on"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontaminate.find_passages(docs_of(rows), benchmark).collect()}
    want = plain.passages(rows, items)
    assert got.keys() == want.keys() and len(want) > 15
    assert got == want
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(rows), benchmark).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in want}


def test_passages_with_moved_parts(spark, docs_of):
    rng = random.Random(14)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    items = [(i, prose(n)) for i, n in enumerate([59, 59, 90, 120, 40])]
    items.append((9, ["again"] * 10 + prose(50)))
    rows = []
    for k, (_, w) in enumerate(items):
        for j in range(12):
            cut = len(w) // 2 if j < 3 else rng.randrange(1, len(w))
            moved = w[cut:] + w[:cut]
            if j > 7:
                a, b = sorted(rng.sample(range(1, len(w)), 2))
                moved = w[b:] + w[a:b] + w[:a]
            rows.append((100 * k + j, " ".join([*prose(rng.choice([0, 35, 80])), *moved, *prose(rng.choice([0, 3, 60]))])))
    items = [(i, " ".join(w)) for i, w in items]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in decontaminate.find_passages(docs_of(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain.passages(rows, items)
    assert got.keys() == want.keys() and len(want) > 30
    assert got == want


def test_passages_without_rows(spark, docs_of, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.find_passages(docs_of(odd_rows), none).collect() == []
    assert decontaminate.find_passages(docs_of([]), items).collect() == []
    assert decontaminate.drop_contaminated(docs_of(odd_rows), none).count() == len(odd_rows)
    null = docs_of([(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "other"), (2, None)])
    assert [r.doc_id for r in decontaminate.drop_contaminated(null, items).collect()] == [2]


def test_blocks_guarantee_the_radius():
    rng = random.Random(5)
    masks = {m for m in range(256) if m.bit_count() <= decontaminate.BLOCK_ERRORS}
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any((change >> 8 * k) & 255 in masks for k in range(8))


def plain_matches(text, templates, threshold):
    """All segments against all templates, without bounds and index."""
    out = []
    lines, at, spans = text.split("\n"), 0, []
    for line in lines:
        spans.append((at, at + len(line)))
        at += len(line) + 1
    full = [bool(x.strip()) for x in lines]
    found = [("line", *spans[i]) for i in range(len(lines)) if full[i]]
    blocks, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and full[j]:
            j += 1
        if j > i:
            blocks.append((spans[i][0], spans[j - 1][1], j - i))
        i = max(j, i + 1)
    found += [("block", b, e) for b, e, n in blocks if n > 1]
    if len(blocks) > 1:
        found.append(("text", 0, len(text)))
    for kind, begin, end in found:
        w = licences.words(text[begin:end])
        a = Counter(zip(w, w[1:], strict=False))
        scores = []
        for licence, name, template in templates:
            t = licences.words(template)
            b = Counter(zip(t, t[1:], strict=False))
            total = sum(a.values()) + sum(b.values())
            dice = 2 * sum((a & b).values()) / total if a and b else 0
            scores.append((-dice, len(t), licence, name))
        dice, _, licence, name = min(scores)
        if -dice >= threshold:
            out.append((kind, begin, end, licence, name, -dice))
    return out


def test_licences(docs_of, odd_rows):
    rng = random.Random(6)
    rows = [(d, t) for d, t in odd_rows if d != 5]
    for k, (_, _, text) in enumerate(licences.TEMPLATES):
        w = text.split()
        rows.append((1000 + k, "before\n\n" + text.upper() + "\nafter words"))
        rows.append((2000 + k, " ".join("x" if rng.random() < 0.06 else x for x in w) + "\n\n\n" + " ".join(w[: len(w) // 2])))
        rows.append((3000 + k, "\n".join(w[i] + " " + " ".join(w[i + 1 : i + 9]) for i in range(0, len(w), 9)) + "\n\nend"))
    for threshold in (0.8, 0.5):
        got = Counter(tuple(r) for r in licences.scan(docs_of(rows), threshold=threshold).collect())
        want = Counter((d, *m) for d, t in rows for m in plain_matches(t or "", licences.TEMPLATES, threshold))
        assert got == want and len(want) > 30
    assert licences.scan(docs_of([])).collect() == []


def test_licences_at_any_place(docs_of):
    texts = {(licence, name): " ".join(text.split()) for licence, name, text in licences.TEMPLATES}
    mit = texts["MIT", "text"]
    parts = [mit[: mit.index("The above")], mit[mit.index("The above") : mit.index("THE SOFTWARE")], mit[mit.index("THE SOFTWARE") :]]
    prose = "\n\n".join(" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12))
    apache = texts["Apache-2.0", "file header"]
    header = "\n".join("# " + apache[i : i + 70] for i in range(0, len(apache), 70))
    full = dict.fromkeys(["Apache-2.0", "GPL-2.0", "GPL-3.0", "BSD-3-Clause"])
    rows = [
        (1, prose + "\n\n" + "\n\n".join(parts) + "\n\n" + prose),
        (2, header.replace("# Licensed", "# x\n# Licensed") + "\n" + prose.replace("\n\n", "\n")),
        (3, prose + " This tool is great. Licensed under the MIT License. See the manual \u0130 for more. " + prose),
        (4, prose),
        *[(10 + k, prose + " " + texts[licence, "text"] + " " + prose) for k, licence in enumerate(full)],
    ]
    found = licences.scan(docs_of(rows), anywhere=True).collect()
    assert {(10 + k, licence, "text") for k, licence in enumerate(full)} <= {(r.doc_id, r.licence, r.template) for r in found}
    found = [r for r in found if r.segment == "passage" and r.doc_id < 10]
    want = [(1, "MIT", "text"), (2, "Apache-2.0", "file header"), (3, "MIT", "notice by")]
    assert sorted((r.doc_id, r.licence, r.template) for r in found) == want
    by_doc = {r.doc_id: (dict(rows)[r.doc_id][r.start : r.stop], r.dice) for r in found}
    assert by_doc[3] == ("Licensed under the MIT License", 1.0)
    assert licences.words(by_doc[1][0]) == licences.words(mit) and by_doc[1][1] == 1.0


def test_plain_words_go_to_the_merges_directly():
    import public_tokenizers

    from gradeloom.llm.word_tokens import WordEncoder

    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["the", "thresten", "s", "re", "don't", "Été", "été", "a1", "x" * 300, "", "<|endoftext|>", "endoftext", "...", "ß", "K"]
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    asked = []
    tokenizer = encoder.tokenizer

    class Asked:
        model = tokenizer.model

        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Asked()
    assert [list(x) for x in encoder.numbers(parts)] == want
    assert "thresten" not in asked and "don't" in asked


def test_a_tokenizer_that_changes_plain_words_gets_them_whole(tmp_path):
    import json

    import public_tokenizers

    from gradeloom.llm.word_tokens import WordEncoder

    told = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    told["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    encoder = WordEncoder(str(path))
    assert not encoder.whole
    assert encoder.numbers(["the"]) == [encoder.tokenizer.encode("the", add_special_tokens=False).ids]
