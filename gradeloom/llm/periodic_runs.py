"""Stretches of repeating words, found while words are appended.

After the online detection of squares by dyadic blocks (Leung, Peng and Ting, "An efficient
algorithm for online square detection", 2006): for each power of two B, each completed block
of B words is a catcher of the squares with a period from B to 2 B - 1. The last B words of
the text are compared with the one catcher whose distance is such a period, so an appended
word costs one comparison for each power of two. Equal windows are squares or parts of them;
squares of one period that touch merge into a run when their common extensions are taken.

Windows are compared by hashes that each level forms from two of the level below; the
runs that come out are checked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, outer_id
from gradeloom.llm.shingles import mix
from gradeloom.llm.word_tokens import ragged, release_memory, slices

REPEATS = 4  # a run holds its period so many times
SHORTEST = 6  # and so many words


class SquareCatchers:
    """Words so far, hashes of their windows, and the squares that the catchers found.

    A run of period q is caught if it has 4 q words or more: with B <= q < 2 B a block lies
    among its first 2 B - 1 words, and so does its repetition q words on before 4 q. Memory
    is eight bytes for each word and power of two up to ``longest`` (the largest period).
    """

    def __init__(self, longest: int, seed: int = 0):
        self.words = np.zeros(0, np.int64)
        self.seed = seed
        self.levels = [np.zeros(0, np.uint64) for _ in range(max(1, longest).bit_length())]
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Append words (numbers); return where windows begin that repeat one ``period`` words before."""
        before, n = len(self.words), len(self.words) + len(words)
        self.words = np.concatenate((self.words, words))
        ends, periods = [], []
        for k, known in enumerate(self.levels):
            size = 1 << k
            if n < size:
                break
            if k == 0:
                new = mix(words.astype(np.uint64), self.seed + 1)
            else:
                below, start = self.levels[k - 1], len(known)
                left, right = below[start : n - size + 1], below[start + size // 2 : n - size // 2 + 1]
                new = mix(left * np.uint64(3) + right, self.seed + k + 1)
            level = self.levels[k] = np.concatenate((known, new)) if len(known) else new
            at = np.arange(max(size, before - size + 1), n - size + 1)
            catcher = (at >> k << k) - size
            hit = np.flatnonzero(level[at] == level[catcher])
            ends.append(at[hit])
            periods.append(at[hit] - catcher[hit])
        found = (np.concatenate(ends), np.concatenate(periods)) if ends else (np.zeros(0, np.int64),) * 2
        self.squares.append(found)
        return found

    def _common(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """Words from a and from b > a on that are equal, or before them."""
        n = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            size, level = 1 << k, self.levels[k]
            live = np.arange(len(a))
            while len(live) and len(level):
                x, y = (a[live] - n[live] - size, b[live] - n[live] - size) if back else (a[live] + n[live], b[live] + n[live])
                inside = (x >= 0) & (y < len(level))
                live, x, y = live[inside], x[inside], y[inside]
                live = live[level[x] == level[y]]
                n[live] += size
                if k < len(self.levels) - 1:
                    break  # of a level below the top, one window at most is left
        return n

    def runs(self) -> np.ndarray:
        """``start, length, period`` of all runs so far, by start, then period."""
        at, period = (np.concatenate(x) for x in zip(*self.squares, strict=True)) if self.squares else (np.zeros(0, np.int64),) * 2
        start = at - period - self._common(at - period, at, back=True)
        end = at + self._common(at - period, at, back=False)
        long = end - start >= np.maximum(SHORTEST, REPEATS * period)
        found = np.unique(np.stack((start[long], end[long], period[long]), axis=1), axis=0)
        # A stretch with a smaller period has its multiples too; the smallest comes first.
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
        found = found[first]
        found[:, 1] -= found[:, 0]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """The runs of a row of words, checked; a hash that deceives is replaced."""
    for seed in range(0, 1 << 16, 64):
        catchers = SquareCatchers(longest, seed)
        catchers.append(words)
        found = catchers.runs()
        if all((words[s : s + n - q] == words[s + q : s + n]).all() for s, n, q in found.tolist()):
            return found
    raise ArithmeticError("hashes of different windows are equal under every seed")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space), and where each text's begin (one more than texts)."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    offsets = split.offsets.to_numpy().astype(np.int64)
    return words.filter(full), before[offsets - offsets[0]]


def text_runs(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of many texts of word numbers: the text of each run, and ``start, length, period`` in it.

    Texts of about one length are one row of words, with a word of its own between two of them.
    """
    lengths = np.diff(starts)
    kind = np.frexp(lengths.astype(float))[1]  # 2^(kind-1) <= length < 2^kind
    texts, found = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    for k in np.unique(kind[lengths >= SHORTEST]).tolist():
        mine = np.flatnonzero(kind == k)
        row, begin = ragged(ids, starts[mine], lengths[mine])
        ends = begin[1:]
        row = np.insert(row, ends, -1 - np.arange(len(ends)))
        begin = begin[:-1] + np.arange(len(mine))
        runs = runs_of(row, int(lengths[mine].max()) // REPEATS)
        place = np.searchsorted(begin, runs[:, 0], "right") - 1
        runs[:, 0] -= begin[place]
        texts.append(mine[place])
        found.append(runs)
    text, runs = np.concatenate(texts), np.concatenate(found)
    order = np.lexsort((runs[:, 2], runs[:, 0], text))
    return text[order], runs[order]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for begin, end in slices(batch["body"]):
            words, starts = split_words(batch["body"].slice(begin, end - begin))
            coded = words.dictionary_encode()
            text, runs = text_runs(coded.indices.to_numpy().astype(np.int64), starts)
            kept = np.ones(len(words), bool)
            for t, (start, length, period) in zip(text.tolist(), runs.tolist(), strict=True):
                kept[starts[t] + start + period : starts[t] + start + length] = False
            left = np.concatenate(([0], np.cumsum(kept)))[starts].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(kept))), " ")
            offsets = np.searchsorted(text, np.arange(end - begin + 1)).astype(np.int32)
            listed = pa.StructArray.from_arrays([pa.array(c) for c in runs.T], fields=list(run_type))
            listed = pa.ListArray.from_arrays(pa.array(offsets), listed)
            columns = [batch["doc"].slice(begin, end - begin), pa.array(np.diff(starts)), listed, collapsed]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "runs", "text"])
    release_memory()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Periodic runs of the words of each text, and the text with each run cut to its first period.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of words
    with a smallest period q (words q apart are identical), of ``max(6, 4 q)`` words or more,
    that no neighbouring word extends. Returns the id, ``n_words``, ``runs`` (structs of
    ``start``, ``length``, ``period``, by start, then period) and ``text``: the words that no
    run holds after its first q, joined by single spaces.

    A null, empty or blank text has no words, no runs and an empty text. Each row is treated on
    its own, also one that repeats an id or has none. An empty table gives no rows. A text is
    worked on as a whole in one task, in memory of eight bytes for each word and power of two
    up to a quarter of its words.
    """
    schema = "doc long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"
    found = documents(docs, id_col, text_col).mapInArrow(_find, schema)
    return found.select(outer_id().alias(id_col), "n_words", "runs", F.col("text").alias(text_col))
