"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gradeloom.llm.word_tokens import WordTable, slices


class WordHashes(WordTable):
    """One 64-bit hash for each word, A-Z in lower case."""

    dtype = np.uint64

    def parts(self, words: pa.Array) -> list[pa.Array]:
        return [pc.ascii_lower(words)]

    def numbers(self, parts: list[str]) -> list[Sequence[int]]:
        return [[xxhash.xxh64_intdigest(word.encode())] if word else [] for word in parts]


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of MurmurHash3 over h + seed (its two factors are fixed values)."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of a text; all its words are one shingle if they are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    span = min(width, len(words))
    n = len(words) - span + 1
    h = np.full(n, span, np.uint64)
    for k in range(span):
        h = mix(h ^ words[k : k + n], k + 1) if k else words[:n] * np.uint64(2) + h
    return np.unique(h)


def shingle_sets(texts: pa.Array, width: int, table: WordHashes):
    """The shingle set of each text in turn."""
    for begin, end in slices(texts):
        words, starts = table.encode(texts.slice(begin, end - begin))
        for i in range(end - begin):
            yield shingle_set(words[starts[i] : starts[i + 1]], width)
