"""Numbers for the words of many texts, by a table of the words seen so far."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4_000_000  # text that is encoded at once
KNOWN_WORDS = 400_000  # parts of words that a task remembers; beyond it starts anew


class WordTable:
    """Encodes texts word by word (runs without ASCII white space) and remembers the words."""

    dtype = np.uint32

    def __init__(self):
        self.forget()

    def parts(self, words: pa.Array) -> list[pa.Array]:
        """Columns of parts that words are looked up by; a word's numbers are those of its parts."""
        return [words]

    def numbers(self, parts: list[str]) -> list[Sequence[int]]:
        """Numbers of each part."""
        raise NotImplementedError

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.zeros(0, self.dtype)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self, parts: list[str]) -> None:
        new = self.numbers(parts)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        base = len(self.start)
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(lengths) - lengths))
        self.length = np.concatenate((self.length, lengths))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(new), self.dtype, int(lengths.sum()))))
        self.place.update(zip(parts, range(base, base + len(parts)), strict=True))

    def _places(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if unknown := [p for p in names if p not in self.place]:
            self._learn(unknown)
        return np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts in a row, and where each text's begin (one more than texts)."""
        if len(self.place) > KNOWN_WORDS:
            self.forget()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        columns = [self._places(part) for part in self.parts(words.dictionary)]
        places = np.stack(columns, axis=1)
        lengths = self.length[places]
        distinct, starts = ragged(self.pool, self.start[places.ravel()], lengths.ravel())
        starts = starts[:: len(columns)]
        codes = words.indices.to_numpy()
        found, ends = ragged(distinct, starts[:-1][codes], np.diff(starts)[codes])
        word_ends = split.offsets.to_numpy().astype(np.int64)
        return found, ends[word_ends - word_ends[0]]


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``values`` one after another, and where each begins (one more than runs)."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return values[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])], ends


class WordEncoder(WordTable):
    """Token ids by a tokenizer that drops white space.

    The tokenizer cuts at white space before it merges, so the ids of a text are those of
    its words one after another. A run of full stops or commas after a letter is a token
    run of its own as well, and letters are lower-cased.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self._keeps_plain_words()

    def _keeps_plain_words(self) -> bool:
        """Whether a word of small ASCII letters gets to the merges as it is, and nothing is cut or added after them."""
        steps = self.tokenizer
        if steps.truncation or steps.padding or any(t.content.isalpha() for t in steps.get_added_tokens_decoder().values()):
            return False
        words = [ascii_lowercase, ascii_lowercase[::-1], *ascii_lowercase, *("re", "ve", "ll")]
        if steps.normalizer and any(steps.normalizer.normalize_str(w) != w for w in words):
            return False
        return not steps.pre_tokenizer or all([p for p, _ in steps.pre_tokenizer.pre_tokenize_str(w)] == [w] for w in words)

    def parts(self, words: pa.Array) -> list[pa.Array]:
        stems = pc.utf8_rtrim(words, ".,")
        # In lower case, U+0130 alone of all letters ends in a character that is no letter.
        apart = pc.match_substring_regex(stems, r"[^\P{L}\x{130}]$")
        tails = pc.replace_substring_regex(words, r"^(?s:.*?)([.,]*)$", r"\1")
        stems = pc.if_else(apart, stems, words)
        plain = pc.and_(pc.string_is_ascii(stems), pc.ascii_is_alpha(stems))
        return [pc.if_else(plain, pc.ascii_lower(stems), stems), pc.if_else(apart, tails, "")]

    def numbers(self, parts: list[str]) -> list[Sequence[int]]:
        plain = [self.whole and p.isascii() and p.isalpha() and p.islower() for p in parts]
        rest = [p for p, known in zip(parts, plain, strict=True) if not known]
        encoded = (x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        merge = self.tokenizer.model.tokenize
        return [[t.id for t in merge(p)] if known else next(encoded) for p, known in zip(parts, plain, strict=True)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The encoder of this worker; a task forgets the words when it ends, as workers live on."""
    return WordEncoder(path)


class WordHasher(WordTable):
    """Hashes of runs of letters and digits and of runs of other characters, below ``buckets``."""

    _PART = re.compile(r"\w+|[^\w\s]+")

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def numbers(self, parts: list[str]) -> list[Sequence[int]]:
        return [[zlib.crc32(p.encode()) % self.buckets for p in self._PART.findall(word)] for word in parts]


def release_memory() -> None:
    """Give memory of finished work back: a Python worker lives on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut an array of texts into ranges of about ``most`` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(sizes):
        before = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield begin, end
        begin = end
