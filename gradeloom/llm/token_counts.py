"""Token counts of fields and sections from one encoding of the whole document.

The fields of a row are put together to one text, which is encoded once. The byte
lengths of the tokens give their spans, the sections of the text are spans as well, and
both lists are sorted, so a merge joins them. A token that crosses a boundary goes to
one section by a stated rule, so the counts of a document add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import NULL_ID, outer_id

RULES = ("most", "first", "last")
COUNTS = "doc long, field string, section int, start int, stop int, n_tokens int, n_crossing int, doc_tokens int"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]
TYPES = [pa.int64(), pa.string(), *[pa.int32()] * 6]


def load_ranks(path: str, pattern: str):
    """Return a byte-level encoding and the byte length of each token id."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section.

    ``ends`` are the byte ends of the tokens, ``bounds`` the byte starts of the sections
    and the end of the last. Empty sections get nothing. ``rule``: a crossing token goes to
    the section with "most" of its bytes (the earlier of equals), its "first" or its "last".
    """
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    to = (last if rule == "last" else first).copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for t in crossing.tolist():
            inside = np.arange(first[t], last[t] + 1)
            held = np.minimum(bounds[inside + 1], ends[t]) - np.maximum(bounds[inside], starts[t])
            to[t] = inside[np.argmax(held)]
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def _count(path: str, pattern: str, fields: list[str], parted: str, rule: str) -> Callable:
    def sections(values: list[str | None]) -> tuple[str, list[tuple[str, int]], list[int]]:
        """The whole text, (field, section) names, and the starts in code points."""
        names, pieces = [], []
        for i, (field, value) in enumerate(zip(fields, values, strict=True)):
            lines = (value or "").split("\n") if field == parted else [value or ""]
            feed = "\n" if i + 1 < len(fields) else ""
            pieces += [x + "\n" for x in lines[:-1]] + [lines[-1] + feed]
            names += [(field, k) for k in range(len(lines))]
        starts = np.cumsum([0, *map(len, pieces)]).tolist()
        return "".join(pieces), names, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_ranks(path, pattern)
        for batch in batches:
            rows: list[list] = [[] for _ in NAMES]
            columns = [batch[f"f{i}"].to_pylist() for i in range(len(fields))]
            for doc, *values in zip(batch["doc"].to_pylist(), *columns, strict=True):
                text, names, starts = sections(values)
                ends = np.cumsum(lengths[encoding.encode_ordinary(text)])
                raw = np.frombuffer(text.encode(), np.uint8)
                places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte of each code point
                tokens, crossing = allocate(ends, places[starts], rule)
                values = ([doc] * len(names), *zip(*names, strict=True), starts[:-1], starts[1:])
                for row, value in zip(rows, (*values, tokens, crossing, [len(ends)] * len(names)), strict=True):
                    row.extend(value)
                if len(rows[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, TYPES, strict=True)], NAMES)
                    rows = [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, TYPES, strict=True)], NAMES)

    return run


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    fields: list[str],
    parted: str = "text",
    rule: str = "most",
    id_col: str = "doc_id",
) -> DataFrame:
    """Count the tokens of every field and section of every row.

    The whole text of a row is its ``fields`` in this order, each but the last followed by
    a line feed that belongs to it; null is empty. The field ``parted`` is cut into
    sections behind each line feed, the others are one section each. An empty section has
    no tokens. ``vocabulary`` is a file of byte-level ranks, ``pattern`` its splitting
    pattern, ``rule`` one of RULES (see ``allocate``).

    One row for each section: id, ``field``, ``section`` (from 0), ``start`` and ``stop``
    (code points of the whole text), ``n_tokens``, ``n_crossing`` (tokens among them that
    reach into another section), ``doc_tokens``. Repeated rows and ids are counted on their
    own, a null id stays null, an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc")
    rows = docs.select(id_, *[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    counts = rows.mapInArrow(_count(vocabulary, pattern, fields, parted, rule), COUNTS)
    return counts.select(outer_id().alias(id_col), *NAMES[1:])
