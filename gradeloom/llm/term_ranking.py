"""Ranked lexical search by scans of the texts, without an index of the documents.

All terms of the items make one Aho-Corasick automaton. Terms stand in it between two
guards, and a text is scanned with all that is no term turned into guards, so a match is
a whole term. The automaton of a scan goes to every task; it is bounded by the characters
of the terms, and items beyond that are dealt to further scans.

A scan runs twice: first it counts documents, terms and the documents of each term, then
it scores. A task keeps the best documents of each item only, so neither texts nor term
counts are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, lower_ascii, outer_id
from gradeloom.llm.word_tokens import ragged, release_memory
from gradeloom.session import cut_lineage

# Fixed value: a term is a longest run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GUARD = b" "
# Bytes of UTF-8 as a scan sees them: A-Z in lower case, ASCII outside of terms as guards.
_SEEN = bytes(b if chr(b).isalnum() or b > 127 else GUARD[0] for b in bytes(range(256)).lower())

SCAN_CHARS = 1_000_000  # characters of terms in one automaton
PIECE = 1_000_000  # bytes of text that are scanned at once
BATCH = 2_000_000  # scores that are added up at once


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, term``: the distinct terms of all rows of an item."""
    rows = documents(items, id_col, text_col)
    terms = F.regexp_extract_all(lower_ascii(F.col("body")), F.lit(TERM), F.lit(0))
    return rows.select(F.col("doc").alias("item"), F.explode(terms).alias("term")).distinct()


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds the places of terms in scanned text, one character for each byte."""
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word((GUARD + term.encode() + GUARD).decode("latin-1"), i)
    found.make_automaton()
    return found


def seen(text: bytes) -> bytes:
    return GUARD + text.translate(_SEEN) + GUARD


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cut at guards, which stand in both pieces, so that no term is cut."""
    begin = 0
    while len(text) - begin > PIECE:
        end = text.rfind(GUARD, begin + 1, begin + PIECE)
        end = end if end > 0 else text.find(GUARD, begin + PIECE)
        if end < 0:
            break
        yield text[begin : end + 1]
        begin = end
    yield text[begin:]


def count_terms(text: bytes) -> int:
    """Terms of a scanned text, with repeats: places where one begins after a guard."""
    term = np.frombuffer(text, np.uint8) != GUARD[0]
    return int(np.count_nonzero(term[1:] & ~term[:-1]))


_second = itemgetter(1)


def matches(found: ahocorasick.Automaton, text: bytes) -> Counter:
    """How often each term occurs."""
    counts: Counter = Counter()
    if len(found):
        for piece in _pieces(text):
            counts.update(map(_second, found.iter(piece.decode("latin-1"))))
    return counts


def _bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
    yield from (seen(x.as_buffer().to_pybytes()) for x in batch["body"].cast(pa.binary()))


def _count(shared, n_items_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition: for each term the documents that hold it; as term -1 all documents and terms."""
        found = shared.value
        holders = np.zeros(n_items_terms, np.int64)
        n_docs = n_terms = 0
        for batch in batches:
            for text in _bodies(batch):
                n = count_terms(text)
                if n:
                    n_docs += 1
                    n_terms += n
                    holders[list(matches(found, text))] += 1
        some = np.flatnonzero(holders)
        columns = [np.append(some, -1), np.append(holders[some], n_docs), np.append(np.zeros_like(some), n_terms)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "n", "total"])
        release_memory()

    return run


class Best:
    """The highest scores of each item, equal ones by the smaller document."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)  # scores below are of no use
        self.kept = [np.zeros((3, 0), np.int64)]
        self.size = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        useful = score >= self.least[item]
        self.kept.append(np.stack((item[useful], score[useful], doc[useful])))
        self.size += int(useful.sum())
        if self.size > 4 * self.top * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> np.ndarray:
        """``item, score, doc`` of the best, in order."""
        rows = np.concatenate(self.kept, axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        rank = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        rows, rank = rows[:, rank < self.top], rank[rank < self.top]
        last = rows[:, rank == self.top - 1]
        self.least[last[0]] = last[1]
        self.kept, self.size = [rows], rows.shape[1]
        return rows


def _score(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition: the best documents of each item."""
        found, weight, items, listed, first, n_docs, n_terms = shared.value
        n_items = len(items)
        best = Best(n_items, top)
        held: list[tuple[int, int, Counter]] = []

        def score() -> None:
            if not held:
                return
            sizes = [len(c) for _, _, c in held]
            row = np.repeat(np.arange(len(held)), sizes)
            term = np.fromiter((t for _, _, c in held for t in c), np.int64, len(row))
            tf = np.fromiter((k for _, _, c in held for k in c.values()), np.int64, len(row))
            m = np.array([50 + 50 * n * n_docs // n_terms for _, n, _ in held], np.int64)[row]
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            holders = first[term + 1] - first[term]
            item, _ = ragged(listed, first[term], holders)
            total = np.zeros((len(held), n_items), np.int64)
            np.add.at(total, (np.repeat(row, holders), item), np.repeat(part, holders))
            rows, item = np.nonzero(total)
            best.add(item, total[rows, item], np.array([d for d, _, _ in held], np.int64)[rows])
            held.clear()

        for batch in batches:
            waiting = 0
            for doc, text in zip(batch["doc"].to_pylist(), _bodies(batch), strict=True):
                counts = matches(found, text)
                if not counts:
                    continue
                held.append((doc, count_terms(text), counts))
                term = np.fromiter(counts, np.int64, len(counts))
                waiting += n_items + int((first[term + 1] - first[term]).sum())
                if waiting > BATCH:
                    score()
                    waiting = 0
            score()
        item, value, doc = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (items[item], value, doc)], ["item", "score", "doc"])
        release_memory()

    return run


def _scan(rows: DataFrame, wanted: DataFrame, top: int) -> DataFrame | None:
    """``item, score, doc``: the best documents that each partition has for the items of ``wanted``."""
    pairs = sorted((r.term, r.item) for r in wanted.collect())  # bounded by the caller
    terms = sorted({t for t, _ in pairs})
    items = sorted({i for _, i in pairs})
    if not pairs:
        return None
    spark = rows.sparkSession
    place = {i: k for k, i in enumerate(items)}
    number = {t: k for k, t in enumerate(terms)}
    first = np.searchsorted([number[t] for t, _ in pairs], np.arange(len(terms) + 1))
    found = automaton(terms)
    counted = rows.mapInArrow(_count(spark.sparkContext.broadcast(found), len(terms)), "term long, n long, total long")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    holders = {r.term: (r.n, r.total) for r in counted.collect()}  # one row for each term of the automaton
    n_docs, n_terms = holders.pop(-1, (0, 0))
    df = np.array([holders.get(k, (0, 0))[0] for k in range(len(terms))], np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    listed = np.array([place[i] for _, i in pairs], np.int64)
    shared = spark.sparkContext.broadcast((found, weight, np.array(items, np.int64), listed, first, n_docs, n_terms))
    return rows.mapInArrow(_score(shared, top), "item long, score long, doc long")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    scan_chars: int = SCAN_CHARS,
) -> DataFrame:
    """The ``top`` documents of each item by the terms that they share.

    Terms are runs of ASCII letters and digits and characters beyond ASCII, A-Z in lower
    case. With N documents that have a term, L terms in them, n terms in a document, df
    documents that hold a term and tf occurrences in a document, a term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document has m = 50 + 50 n N div L and the
    score sum w (10^9 tf div (1000 tf + 20 m)) over the terms of the item, each once.

    Returns the item's id, ``rank`` from 1, the document's id and ``score``, for scores above
    0; equal scores by ascending id, a null id first. Null and empty texts and texts without
    terms are no documents, items without terms have no rows. Every row is a document, also
    one that repeats an id or a text; rows that repeat an item's id are one item with the terms
    of all of them. Empty tables give no rows.

    ``scan_chars`` bounds the characters of terms in one automaton (a single item may go
    beyond it); with more, items are dealt to as many scans as are needed.
    """
    rows = documents(docs, id_col, text_col)
    wanted = cut_lineage(item_terms(items, item_col, item_text_col))
    chars = wanted.agg(F.sum(F.char_length("term"))).first()[0] or 0
    scans = max(1, math.ceil(chars / scan_chars))
    dealt = F.pmod(F.xxhash64("item"), F.lit(scans))
    found = [_scan(rows, wanted.where(dealt == k), top) for k in range(scans)]
    found = [f for f in found if f is not None]
    schema = f"`{item_col}` long, rank int, `{id_col}` long, score long"
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = [F.col("score").desc(), F.col("doc")]
    # First within parts of an item, so that the last step sees at most 64 times top rows of it.
    within = Window.partitionBy("item", F.pmod(F.xxhash64("doc"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    best = best.where(F.col("rank") <= top)
    return best.select(outer_id("item").alias(item_col), "rank", outer_id().alias(id_col), "score")
