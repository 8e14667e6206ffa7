"""Removal of repeated byte strings by prefix doubling over content-defined places.

A suffix array of all bytes would sort every position. Here only anchors are sorted: equal
windows have their anchor at the same distance, so windows are compared by anchor and
distance, and all windows of an anchor are one row (see ``anchors``).

Rows are ranked and sorted in rounds. In each, a row stands for neighbouring windows at
some distances from their anchor; its rank is the pair of the rank before and the bytes
that all of its windows hold, which grow from round to round until they are the whole
window. A row whose rank is unique goes. Rows with equal bytes over all of their windows
are repeated there and settled. The others go on with fewer windows to a row.

A sorted row needs its two neighbours only, so ranges are cut anywhere, also inside of a
rank that a third of all rows have; the first and last row of each range meet in a small
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.anchors import SPREAD, WINDOW, ByteHash, anchor_rows, scramble
from gradeloom.llm.common import documents, outer_id, row_key
from gradeloom.llm.word_tokens import release_memory, slices
from gradeloom.session import cut_lineage

# Distances that one row stands for, by round after the first (there all of an anchor's).
ROUNDS = (32, 8, 1)
SEGMENT = 250_000  # bytes that are hashed at once; longer texts are cut into overlapping segments
MOST_BYTES = 2_000_000  # of text, compressed or not, that a task works on at once

ROW = "r1 long, r2 long, hull long, key long, place long"
SORTED = ["r1", "r2", "hull", "key", "place"]
SETTLED = f"kind string, {ROW}, bytes binary"


def packed(anchor: np.ndarray, far: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Place of a row: anchor and largest and smallest distance of a window start before it."""
    return anchor << 16 | far << 8 | near


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 0xFF, place & 0xFF


def segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Join texts to about SEGMENT bytes; (text, offset in it, begin, end) of each piece.

    A long text is cut into pieces that overlap so that each window is in exactly one.
    """
    buffer, places, size = [], [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - WINDOW + 1, 0), SEGMENT):
            piece = text[offset : offset + SEGMENT + WINDOW - 1]
            if size and size + len(piece) > SEGMENT:
                yield b"".join(buffer), places
                buffer, places, size = [], [], 0
            buffer.append(piece)
            places.append((i, offset, size, size + len(piece)))
            size += len(piece)
    if places:
        yield b"".join(buffer), places


def _bounded(run: Callable) -> Callable:
    """``run`` over batches cut to a few MB of text; a worker gives memory back when its task ends."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = next(n for n in ("body", "packed", "bytes") if n in batch.schema.names)
            for begin, end in slices(batch[name], MOST_BYTES):
                yield batch.slice(begin, end - begin)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        release_memory()

    return bounded


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First round: each anchor with all of its windows, ranked by the bytes that they share."""
    for batch in batches:
        keys = batch["key"].to_numpy(zero_copy_only=False)
        for data, places in segments([t.encode() for t in batch["body"].to_pylist()]):
            texts, offsets, starts, ends = (np.array(c, np.int64) for c in zip(*places, strict=True))
            piece, anchor, first, last, gram, hull = anchor_rows(np.frombuffer(data, np.uint8), starts, ends)
            far, near = anchor - first, anchor - last
            hull = hull + (far.astype(np.uint64) << np.uint64(8)) + near.astype(np.uint64)
            place = packed(anchor - starts[piece] + offsets[piece], far, near)
            rank = (gram >> np.uint64(16)).astype(np.int64)
            columns = [rank, np.zeros(len(rank), np.int64), hull, keys[texts[piece]], place]
            yield pa.RecordBatch.from_arrays([_long(c) for c in columns], SORTED)


# --- one round ----------------------------------------------------------------------


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with its neighbours.

    "mark": another row has the same rank and the same bytes. "unit": another row has the
    same rank with other bytes; of equal rows the first or last goes on for all. "edge":
    the first and last row of the partition, whose neighbours are elsewhere.
    """
    names = ["kind", *SORTED, "bytes"]
    carry, first = None, True

    def rows(kind: str, table: pa.Table, keep: np.ndarray) -> pa.RecordBatch:
        taken = table.filter(pa.array(keep)).combine_chunks()
        arrays = [taken[c].combine_chunks() for c in SORTED]
        held = taken["bytes"].combine_chunks() if kind != "mark" and "bytes" in taken.column_names else pa.nulls(len(taken), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(taken), pa.string()), *arrays, held], names)

    def judged(table: pa.Table, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        """Rows [begin, end); the rows around them are there if they exist."""
        r1, r2, hull = (table[c].to_numpy() for c in SORTED[:3])
        rank = np.concatenate(([False], (r1[1:] == r1[:-1]) & (r2[1:] == r2[:-1]), [False]))
        same = rank.copy()
        same[1:-1] &= hull[1:] == hull[:-1]
        before, after = slice(begin, end), slice(begin + 1, end + 1)
        mark = same[before] | same[after]
        head = rank[before] & ~same[before]
        tail = rank[after] & ~same[after]
        part = table.slice(begin, end - begin)
        yield rows("mark", part, mark)
        yield rows("unit", part, head | tail)

    for batch in batches:
        if not batch.num_rows:
            continue
        # The row before the carried one is carried as well, to compare with.
        table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
        if first:
            yield rows("edge", table, np.arange(len(table)) == 0)
        begin = 0 if first else min(1, len(table) - 1) if len(carry) == 2 else 0
        yield from judged(table, begin, len(table) - 1)
        first = False
        carry = table.slice(max(0, len(table) - 2))
    if carry is not None:
        yield from judged(carry, len(carry) - 1, len(carry))
        yield rows("edge", carry, np.arange(len(carry)) == len(carry) - 1)


def settle(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sort rows by rank; return repeated rows (``key, place``) and rows that go on."""
    ranged = found.repartitionByRange(*SORTED).sortWithinPartitions(*SORTED)
    settled = cut_lineage(ranged.mapInArrow(_settle, SETTLED))
    # Two rows of each partition; a partition of one row gives the same one twice.
    edges = settled.where("kind = 'edge'").groupBy(*SORTED).agg(F.first("bytes").alias("bytes"))
    same = edges.groupBy("r1", "r2", "hull").agg(F.count("*").alias("n"))
    rank = edges.groupBy("r1", "r2").agg(F.count("*").alias("m"))
    edges = edges.join(F.broadcast(same), ["r1", "r2", "hull"]).join(F.broadcast(rank), ["r1", "r2"])
    marks = settled.where("kind = 'mark'").select("key", "place").unionByName(edges.where("n > 1").select("key", "place"))
    go_on = settled.where("kind = 'unit'").select(*SORTED, "bytes").unionByName(edges.where("m > 1").select(*SORTED, "bytes"))
    return marks, go_on.dropDuplicates(SORTED)


def _parts(far: np.ndarray, near: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Cut distances near..far at multiples of ``size``: row, far and near of the part, number of the cut."""
    count = far // size - near // size + 1
    row = np.repeat(np.arange(len(far)), count)
    cut = near[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, np.minimum(far[row], cut * size + size - 1), np.maximum(near[row], cut * size), cut


def _refined(data: np.ndarray, base: np.ndarray, rank: np.ndarray, keys: np.ndarray, place: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of the next round; ``base`` is where the anchors' texts would begin in ``data``."""
    anchor, far, near = unpacked(place)
    row, far, near, cut = _parts(far, near, size)
    at = base[row] + anchor[row]
    hashes = ByteHash(data)
    # Bytes that the windows at all distances of the cut share, whether or not the row has them all.
    shared = hashes.parts(at - cut * size, at - cut * size - size + 1 + WINDOW)
    hull = hashes.parts(at - far, at - near + WINDOW)
    hull = hull + (far.astype(np.uint64) << np.uint64(8)) + near.astype(np.uint64)
    raw = data.tobytes()
    held = [raw[b:e] for b, e in zip((at - far).tolist(), (at - near + WINDOW).tolist(), strict=True)] if size > 1 else None
    columns = [rank[row], scramble(shared + cut.astype(np.uint64)), hull, keys[row], packed(anchor[row], far, near)]
    bytes_ = pa.array(held, pa.binary()) if held is not None else pa.nulls(len(row), pa.binary())
    return pa.RecordBatch.from_arrays([*map(_long, columns), bytes_], [*SORTED, "bytes"])


def pair_rank(r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
    return scramble(r1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + r2.view(np.uint64)).view(np.int64)


def _from_texts(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch["key"].to_pylist(), batch["packed"].to_pylist(), batch["units"].to_pylist())
            for key, body, units in zip(*columns, strict=True):
                data = np.frombuffer(zstandard.decompress(body), np.uint8)
                rank, place = (np.array([u[c] for u in units], np.int64) for c in ("rank", "place"))
                # A text is taken in pieces around its anchors, so that a long one is not hashed as a whole.
                order = np.argsort(place, kind="stable")
                rank, place = rank[order], place[order]
                piece = (place >> 16) // SEGMENT
                for p in np.unique(piece).tolist():
                    mine = piece == p
                    begin = max(0, p * SEGMENT - SPREAD)
                    part = data[begin : (p + 1) * SEGMENT + WINDOW]
                    keys = np.full(int(mine.sum()), key, np.int64)
                    yield _refined(part, np.full(len(keys), -begin, np.int64), rank[mine], keys, place[mine], size)

    return run


def _from_bytes(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = batch["bytes"].to_pylist()
                data = np.frombuffer(b"".join(held), np.uint8)
                begins = np.cumsum([0, *map(len, held[:-1])])
                rank = pair_rank(*(batch[c].to_numpy() for c in ("r1", "r2")))
                place = batch["place"].to_numpy()
                anchor, far, _ = unpacked(place)
                yield _refined(data, begins - (anchor - far), rank, batch["key"].to_numpy(), place, size)

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed_ = [compress(t.encode()) for t in batch["body"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["key"], pa.array(packed_, pa.binary())], ["doc", "key", "packed"])


def _joinable(rows: DataFrame) -> DataFrame:
    """Compressed texts, which go through a shuffle twice."""
    return rows.select("doc", "body", row_key()).mapInArrow(_bounded(_compressed), "doc long, key long, packed binary")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """``key, place`` of all windows with an equal one elsewhere; ``rows`` has ``doc`` and ``body``."""
    found = rows.select("body", row_key()).mapInArrow(_bounded(_anchors), ROW)
    marks, units = settle(found)
    schema = f"{ROW}, bytes binary"
    grouped = units.select("key", F.struct(F.col("r1").alias("rank"), "place").alias("unit")).groupBy("key")
    listed = grouped.agg(F.collect_list("unit").alias("units"))  # one unit for SPREAD / 2 bytes of the text or so
    texts = _joinable(rows).join(listed.hint("shuffle_hash"), "key").dropDuplicates(["key"])
    found = texts.select("key", "packed", "units").mapInArrow(_bounded(_from_texts(ROUNDS[0])), schema)
    for size in (*ROUNDS[1:], None):
        more, units = settle(cut_lineage(found))
        marks = marks.unionByName(more)
        if size:
            found = units.mapInArrow(_bounded(_from_bytes(size)), schema)
    return marks


def merged(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that the windows cover."""
    anchor, far, near = unpacked(places)
    begin, end = anchor - far, anchor - near + WINDOW
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], np.append(end[:-1][new[1:]], end[-1])


SPANS = "doc long, n_bytes long, spans array<struct<begin:long,end:long>>, kept_sha256 string"


def _cut(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, digests, kept = [], [], [], []
            for body, places in zip(batch["packed"].to_pylist(), batch["places"].to_pylist(), strict=True):
                text = zstandard.decompress(body)
                begin, end = merged(np.array(places, np.int64)) if places else ((), ())
                begin, end = list(map(int, begin)), list(map(int, end))
                rest = b"".join(text[b:e] for b, e in zip([0, *end], [*begin, len(text)], strict=True))
                sizes.append(len(text))
                spans.append([{"begin": b, "end": e} for b, e in zip(begin, end, strict=True)])
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest)
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [batch["doc"], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())]
            names = ["doc", "n_bytes", "spans", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Remove every byte that a string of 200 bytes covers which starts elsewhere, too.

    A text is its UTF-8 bytes, a null text is empty. Strings never cross texts, may overlap
    themselves, and are those of the input. All copies go, so equal rows lose all bytes if
    they have 200. Rows that repeat an id with another text are texts of their own. A null
    id stays null, an empty table gives no rows.

    Returns for each row the id, ``n_bytes``, ``spans`` (maximal removed runs, in bytes),
    ``kept_sha256`` of the remaining bytes, and with ``keep_text`` these as ``kept``.
    """
    rows = documents(docs, id_col, text_col)
    places = repeated_windows(rows).groupBy("key").agg(F.collect_list("place").alias("places"))
    joined = _joinable(rows).join(places.hint("shuffle_hash"), "key", "left").select("doc", "packed", "places")
    found = joined.mapInArrow(_bounded(_cut(keep_text)), SPANS + (", kept binary" if keep_text else ""))
    return found.select(outer_id().alias(id_col), *[c for c in found.columns if c != "doc"])
