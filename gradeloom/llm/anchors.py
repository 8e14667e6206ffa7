"""Content-defined anchors of byte windows, for many texts at once.

A window is WINDOW bytes. Its anchor is the place of the GRAM bytes in it with the
smallest hash, the last of equals. Equal windows have the anchor at the same distance, so
only places behind equal grams need to be compared. The windows that share an anchor
start at neighbouring places; they are one row.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WINDOW = 200
SPREAD = 128  # places of a gram in a window, a power of two
GRAM = WINDOW - SPREAD + 1
_ODD = 0x9E3779B97F4A7C15  # factor of the polynomial, odd and therefore invertible


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class ByteHash:
    """Hashes of any parts of a byte array, from sums of value * factor^place modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = 1 << max(18, int(len(data)).bit_length())
        self.back = _powers(n, pow(_ODD, -1, 2**64))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * _powers(n, _ODD)[: len(data)], out=self.sums[1:])

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return scramble(h)

    def grams(self, width: int) -> np.ndarray:
        h = self.sums[width:] - self.sums[:-width]
        h *= self.back[: len(h)]
        return scramble(h)


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of polynomial hashes, whose low bits are weak; changes ``h``."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def anchor_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the texts at data[starts:ends] (one after another).

    Returns ``text`` (index), ``anchor``, ``first`` and ``last`` window start (places in
    ``data``), ``gram`` hash and ``hull`` hash (all bytes of these windows).
    """
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW or not (ends - starts >= WINDOW).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = ByteHash(data)
    gram = hashes.grams(GRAM)
    least = _running(gram, SPREAD, np.minimum)  # of the window at each place
    # A place is the least of a window if it equals the largest of the least values around it.
    padded = np.concatenate((np.full(SPREAD - 1, least[0]), least, np.full(SPREAD - 1, least[-1])))
    # Windows that would begin before the data or end behind it are none, so their places repeat real ones.
    around = _running(padded, SPREAD, np.maximum)
    place = np.flatnonzero(gram == around)
    value = gram[place]
    first = np.zeros(len(place), np.int64)
    takes_over = value[1:] <= value[:-1]
    first[1:] = np.where(takes_over, np.maximum(place[1:] - SPREAD + 1, 0), place[:-1] + 1)
    # The windows of a place end where those of the next place with any windows begin.
    first = np.maximum.accumulate(first)
    last = np.append(first[1:] - 1, len(least) - 1)
    text = np.searchsorted(starts, place, "right") - 1
    first = np.maximum(first, starts[text])
    last = np.minimum(np.minimum(last, place), ends[text] - WINDOW)
    keep = (first <= last) & (first >= place - SPREAD + 1)
    text, place, first, last, value = text[keep], place[keep], first[keep], last[keep], value[keep]
    return text, place, first, last, value, hashes.parts(first, last + WINDOW)
