"""Licence scan: segments of a text against licence templates.

A text is cut into segments: its lines, its blocks (lines without an empty line in
between) and the whole text. A segment is normalised to words and compared with the
templates by the Dice coefficient over word bigrams, counted with repetition. The two
numbers of bigrams bound the coefficient, which leaves few templates for a segment and
none for most. Passages are windows of words at any place: a window that reaches the
threshold holds a number of the template's bigrams, so it is looked for only where these
stand close enough together.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeloom.llm.common import documents, outer_id
from gradeloom.llm.licence_templates import TEMPLATES

_WORD = re.compile(r"\w+")
MATCHES = "doc long, segment string, start int, stop int, licence string, template string, dice double"
NAMES = [x.split()[0] for x in MATCHES.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64()]


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return _WORD.findall(text.lower())


class Scanner:
    """Templates by number of bigrams, and an index from bigrams to templates."""

    def __init__(self, templates: list[tuple[str, str, str]], threshold: float):
        self.threshold = threshold
        found = [(licence, name, words(text)) for licence, name, text in templates]
        self.templates = sorted(((len(w) - 1, licence, name, w) for licence, name, w in found), key=lambda t: t[:3])
        self.sizes = [t[0] for t in self.templates]
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for i, (_, _, _, w) in enumerate(self.templates):
            for pair, n in Counter(zip(w, w[1:], strict=False)).items():
                self.index[pair].append((i, n))

    def candidates(self, n: int) -> range:
        """Dice is 2 * common / (n + m) and common at most the smaller of n and m."""
        ratio = self.threshold / (2 - self.threshold)
        return range(bisect_left(self.sizes, n * ratio - 1e-9), bisect_right(self.sizes, n / ratio + 1e-9))

    def best(self, segment: list[str]) -> tuple[str, str, float] | None:
        """The best template at the threshold or above; of equals the first by size and name."""
        n = len(segment) - 1
        if n < 1 or not (allowed := self.candidates(n)):
            return None
        common: Counter[int] = Counter()
        for pair, k in Counter(zip(segment, segment[1:], strict=False)).items():
            for i, m in self.index.get(pair, ()):
                if i in allowed:
                    common[i] += min(k, m)
        scored = [(-2 * c / (n + self.sizes[i]), i) for i, c in common.items()]
        if not scored or -(score := min(scored))[0] < self.threshold:
            return None
        _, licence, name, _ = self.templates[score[1]]
        return licence, name, -score[0]


    def windows(self, found: list[str], first: int, closed: dict[int, list[tuple[int, int]]]) -> Iterator[tuple]:
        """For each place where a window can begin the best one: common bigrams, Dice, template, first and last bigram.

        ``first`` is the place of ``found`` in its text, ``closed`` has the words of templates that were found.
        """
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        codes: dict[tuple[str, str], int] = {}
        for at, pair in enumerate(zip(found, found[1:], strict=False), first):
            for i, m in self.index.get(pair, ()):
                # A window does not reach over a closed part: hits before and behind one are apart.
                if i in closed:
                    if any(a <= at + 1 and at < b for a, b in closed[i]):
                        continue
                    part = sum(b <= at for _, b in closed[i])
                else:
                    part = 0
                hits[i, part].append((at, codes.setdefault(pair, len(codes)), m))
        ratio = self.threshold / (2 - self.threshold)
        for (i, _), listed in hits.items():
            size = self.sizes[i]
            least, most = max(1, ceil(size * ratio - 1e-9)), floor(size / ratio + 1e-9)
            if len(listed) < least:
                continue
            at, code, allowed = np.array(listed).T
            rank, seen = np.empty(len(at), np.int64), Counter()
            for k, c in enumerate(code.tolist()):
                rank[k] = seen[c]
                seen[c] += 1
            for k in np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < most).tolist():
                end = int(np.searchsorted(at, at[k] + most))
                before = np.bincount(code[:k], minlength=len(codes))[code[k:end]]
                common = np.cumsum(rank[k:end] - before < allowed[k:end])
                dice = 2 * common / (at[k:end] - at[k] + 1 + size)
                if dice[b := int(np.argmax(dice))] >= self.threshold:
                    yield int(common[b]), float(dice[b]), i, int(at[k]), int(at[k + b])

    def passages(self, found: list[str], matched: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str, float]]:
        """Windows of words that do not overlap, most common bigrams first: first and last word, licence, template, Dice.

        ``matched`` are the words of segments (first, behind the last) and their templates, which are not found there again.
        """
        closed = defaultdict(list)
        for a, b, *template in matched:
            closed[next(i for i, t in enumerate(self.templates) if [*t[1:3]] == template)].append((a, b))
        todo = [(0, len(found))]
        while todo:
            lo, hi = todo.pop()
            ranked = sorted((-c, -dice, i, a, b) for c, dice, i, a, b in self.windows(found[lo:hi], lo, closed))
            taken = bytearray(hi - lo)
            for _, dice, i, a, b in ranked:
                if not any(taken[a - lo : b + 2 - lo]):
                    taken[a - lo : b + 2 - lo] = b"\x01" * (b + 2 - a)
                    yield a, b + 1, *self.templates[i][1:3], -dice
            if ranked:
                todo += [(lo + m.start(), lo + m.end()) for m in re.finditer(rb"\x00{2,}", bytes(taken))]


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """The words of a text with their places in code points."""
    return [(w, m.start(), m.end()) for m in _WORD.finditer(text) for w in words(m.group())]


def segments(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """Lines, blocks of several lines, and the text if it has several blocks, with their words."""
    at, block, block_start, everything, n_blocks, n_lines = 0, [], 0, [], 0, 0
    for line in [*text.split("\n"), ""]:
        found = words(line)
        if line.strip():
            yield "line", at, at + len(line), found
            if not n_lines:
                block_start = at
            block.extend(found)
            n_lines, stop = n_lines + 1, at + len(line)
        elif n_lines:
            if n_lines > 1:
                yield "block", block_start, stop, block
            everything.extend(block)
            n_blocks += 1
            block, n_lines = [], 0
        at += len(line) + 1
    if n_blocks > 1:
        yield "text", 0, len(text), everything


def text_matches(scanner: Scanner, text: str, anywhere: bool) -> list[tuple]:
    """Segments that match a template, and passages elsewhere."""
    rows, matched, everything = [], [], []
    for kind, start, stop, found in segments(text):
        if kind == "line":
            everything += found
        if match := scanner.best(found):
            rows.append((kind, start, stop, *match))
            matched.append((len(everything) - len(found), len(everything), *match[:2]))
    if anywhere and (own := list(scanner.passages(everything, matched))):
        spans = word_spans(text)
        rows += [("passage", spans[a][1], spans[b][2], *match) for a, b, *match in own]
    return rows


def _scan(templates: list[tuple[str, str, str]], threshold: float, anywhere: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [
                (doc, *match)
                for doc, text in zip(batch["doc"].to_pylist(), batch["body"].to_pylist(), strict=True)
                for match in text_matches(scanner, text, anywhere)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

    return run


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str, str]] | None = None,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    anywhere: bool = False,
) -> DataFrame:
    """Find licence texts and notices in every document.

    ``templates`` are (licence, name, text); the default is the list of the library. Every
    segment whose best template reaches ``threshold`` is a row: id, ``segment`` ("line",
    "block" or "text"), ``start`` and ``stop`` in code points, ``licence``, ``template``,
    ``dice``. Of equally good templates the one with fewer bigrams counts, then the first
    name. With ``anywhere`` windows of words at any place that reach it are rows with the
    segment "passage", whatever lines and blocks they stand in: of windows that overlap the
    one with the most common bigrams, then the highest coefficient. A template is not found
    again in a segment that matched it. Null and empty texts and segments of fewer than two words match nothing. Repeated
    rows and ids are scanned on their own, a null id stays null, an empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    matches = rows.mapInArrow(_scan(list(templates or TEMPLATES), threshold, anywhere), MATCHES)
    return matches.select(outer_id().alias(id_col), *NAMES[1:])
