"""Packing of token ids into sequences of bounded length.

Each partition keeps a fixed number of open windows. A piece goes to the window it fits
best. When it fits none and all windows are open, the fullest is filled up with the head
of the piece and emitted. At the end of a partition its open windows are merged, which
leaves at most one that is not full; those of all partitions are merged by best fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, outer_id
from gradeloom.llm.word_tokens import release_memory, slices, word_encoder
from gradeloom.session import cut_lineage

WINDOWS = 32  # open windows of a partition
END_ID = 2
MERGED_TOGETHER = 1024  # unfilled windows that one task merges


class Windows:
    """Open windows of one partition; ``pieces`` collects rows of sequences that are closed."""

    def __init__(self, size: int, most_open: int, first_id: int):
        self.size, self.most_open, self.next_id = size, most_open, first_id
        self.open: list[list] = []  # of [tokens, [(doc, start, ids, doc_tokens), ...]]
        self.pieces: list[tuple] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            rest = total - start
            if rest >= self.size:
                window, take = [0, []], self.size
            else:
                window = min((w for w in self.open if self.size - w[0] >= rest), key=lambda w: self.size - w[0], default=None)
                take = rest
                if window is None and len(self.open) < self.most_open:
                    self.open.append(window := [0, []])
                elif window is None:
                    window = max(self.open, key=lambda w: w[0])
                    take = self.size - window[0]
            self._put(window, (doc, start, ids[start : start + take], total))
            start += take

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        if window[0] == self.size:
            self.open = [w for w in self.open if w is not window]
            self._emit(window, False)

    def _emit(self, window: list, unfilled: bool) -> None:
        offset = 0
        for doc, start, ids, total in window[1]:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.pieces.append((doc, start, len(ids), crc, total, self.next_id, offset, unfilled, ids))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Move the pieces of the emptiest windows into the fullest, cut where they fill one."""
        while len(self.open) > 1:
            self.open.sort(key=lambda w: w[0])
            _, pieces = self.open.pop(0)
            for doc, start, ids, total in pieces:
                while len(ids) and self.open:
                    window = max(self.open, key=lambda w: w[0])
                    head = ids[: self.size - window[0]]
                    self._put(window, (doc, start, head, total))
                    start, ids = start + len(head), ids[len(head) :]
                if len(ids):
                    self.open.append([0, []])
                    self._put(self.open[-1], (doc, start, ids, total))
        for window in self.open:
            self._emit(window, True)
        self.open = []


PIECES = (
    "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, unfilled boolean"
)


def _pack(tokenizer: str, size: int, windows: int, with_ids: bool) -> Callable:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.bool_()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        # A partition's number is the same when it is computed again, and so are its sequences.
        state = Windows(size, windows, TaskContext.get().partitionId() << 32)

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*state.pieces, strict=True)) or [[]] * 9
            state.pieces = []
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for batch in batches:
            body = batch["body"]
            for begin, end in slices(body):
                ids, at = encoder.encode(body.slice(begin, end - begin))
                for i, doc in enumerate(batch["doc"].slice(begin, end - begin).to_pylist()):
                    state.add(doc, np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)))
                yield batch_of()
        encoder.forget()
        state.finish()
        yield batch_of()
        release_memory()

    return run


def _merge(size: int) -> Callable:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Best fit, longest first: where each unfilled window goes, and from which offset."""
        bins: list[list[int]] = []  # of [sequence, tokens]
        out = []
        for seq, tokens in sorted(zip(group["sequence_id"], group["tokens"], strict=True), key=lambda x: (-x[1], x[0])):
            best = max((b for b in bins if b[1] + tokens <= size), key=lambda b: b[1], default=None)
            if best is None:
                bins.append(best := [seq, 0])
            out.append((seq, best[0], best[1]))
            best[1] += tokens
        return pd.DataFrame(out, columns=["sequence_id", "into", "shift"])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    windows: int = WINDOWS,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    A document is the ids of its text by ``tokenizer`` (a file of one that drops white
    space) and then id 2; a null or empty text is that id alone. Every id is in exactly
    one piece; a document longer than a sequence, or one that fills a window up, is cut.
    Rows that repeat an id are packed as documents of their own. A null id stays null.
    An empty table gives no rows.

    One row for each piece: id, ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian 32-bit words), ``doc_tokens``,
    ``sequence_id``, ``offset`` (tokens of the sequence before it), and ``ids`` if
    ``with_ids`` is set. Numbers of sequences are unique, not gapless.
    """
    rows = documents(docs, id_col, text_col)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = cut_lineage(rows.mapInArrow(_pack(tokenizer, size, windows, with_ids), schema))
    unfilled = pieces.where("unfilled").groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    # A partition leaves one unfilled window at most, so a group holds MERGED_TOGETHER of them at most.
    partition = F.shiftright("sequence_id", 32)
    moves = unfilled.groupBy(F.floor(partition / MERGED_TOGETHER).alias("task")).applyInPandas(
        _merge(size), "sequence_id long, into long, shift long"
    )
    moved = pieces.where("unfilled").join(moves, "sequence_id")
    moved = moved.withColumn("offset", F.col("offset") + F.col("shift")).withColumn("sequence_id", F.col("into"))
    columns = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    packed = pieces.where("not unfilled").select("doc", *columns).unionByName(moved.select("doc", *columns))
    return packed.select(outer_id().alias(id_col), *columns)
