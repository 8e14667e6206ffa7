"""Line deduplication by range-partitioned line hashes.

Lines long enough to count are hashed in the scan. The hashes are range-partitioned
and sorted by hash, document (largest first) and position; a stream over each sorted
partition sees the keeping document of a hash first and lets every later one go. The
range boundaries fall between documents, so a line that a third of all documents hold
is spread over many partitions; only the first and last hash of a partition can go on
elsewhere, and their counts are put together from one small row for each partition.
What comes out are compressed bitmaps of kept lines, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import SPACES, document_columns, documents, key128, lower_ascii, outer_id
from gradeloom.session import cut_lineage

# kind: "drop" rows are final, "open" rows belong to a hash that may go on in another
# partition, "part" rows hold what this partition saw of such a hash.
STREAMED = "kind string, h1 long, h2 long, doc long, fp long, n_docs long, lines array<int>"
BITMAPS = "doc long, fp long, n_lines long, n_dropped long, keep_bitmap binary"


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points: hash, document, position."""
    lines = docs.select(
        "doc", F.xxhash64("body").alias("fp"), F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line")
    )
    key = lower_ascii(F.trim(F.col("line"), F.lit(SPACES)))
    keyed = lines.select("doc", "fp", "line_no", key.alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(*key128(F.col("key")), "doc", "fp", "line_no")


def _stream(min_docs: int):
    types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int32())]
    names = ["kind", "h1", "h2", "doc", "fp", "n_docs", "lines"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pass a sorted partition once; hold rows of fewer than ``min_docs`` documents."""
        out: list[tuple] = []
        hash_, top, last, n_docs, first = None, None, None, 0, True
        held: list[tuple[int, int, list[int]]] = []

        def put(kind: str, rows: list[tuple[int, int, list[int]]]) -> None:
            out.extend((kind, *hash_, d, f, None, lines) for d, f, lines in rows)

        for batch in batches:
            h1, h2, doc, fp, line = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
            starts = np.flatnonzero(new)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(h1)], strict=True):
                here, d = (int(h1[s]), int(h2[s])), int(doc[s])
                if here != hash_:
                    if hash_ is not None and first:
                        out.append(("part", *hash_, top, None, n_docs, None))
                        first = False
                    hash_, top, last, n_docs, held = here, d, None, 0, []
                n_docs += d != last
                last = d
                row = (d, int(fp[s]), line[s:e].tolist())
                if first:
                    put("open", [row])
                elif n_docs < min_docs:
                    held.append(row)
                else:  # the largest document came first and keeps its lines
                    put("drop", [x for x in (*held, row) if x[0] != top])
                    held = []
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
        if hash_ is not None:
            put("open", held)
            out.append(("part", *hash_, top, None, n_docs, None))
        yield batch_of(out)

    return run


def dropped_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Lines to drop, as ``doc, fp, lines``; ``rows`` has ``doc`` and ``body``."""
    ranged = line_hashes(rows, min_chars).repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc())
    ordered = ranged.sortWithinPartitions("h1", "h2", F.col("doc").desc(), "fp", "line_no")
    streamed = cut_lineage(ordered.mapInArrow(_stream(min_docs), STREAMED))
    # At most two hashes of a partition stay open, so this table has two rows for each partition at most.
    whole = streamed.where("kind = 'part'").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc").alias("top"))
    settled = streamed.where("kind = 'open'").join(F.broadcast(whole), ["h1", "h2"])
    settled = settled.where((F.col("n") >= min_docs) & (F.col("doc") < F.col("top")))
    return streamed.where("kind = 'drop'").select("doc", "fp", "lines").unionByName(settled.select("doc", "fp", "lines"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n_dropped = [], []
        for n, lines in zip(batch["n_lines"].to_pylist(), batch["lines"].to_pylist(), strict=True):
            keep = np.ones(n, bool)
            for part in lines or ():
                keep[part] = False
            kept.append(zlib.compress(np.packbits(keep).tobytes()))
            n_dropped.append(n - int(keep.sum()))
        columns = [batch["doc"], batch["fp"], batch["n_lines"], pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "fp", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """Return for each document which of its lines stay.

    A text is split at line feeds; a null or empty text is one empty line. The key of a
    line is the line without white space at both ends, A-Z in lower case. A key of at
    least ``min_chars`` code points that is in at least ``min_docs`` documents (distinct
    ids) loses all its lines except those in the largest id; repeated lines within that
    document stay. Shorter lines always stay. A null id is the smallest.

    One row for each distinct (id, text): ``doc`` (internal id), ``fp`` (hash of the text),
    ``n_lines``, ``n_dropped``, ``keep_bitmap`` (zlib of one bit a line, highest bit first).
    An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    drops = dropped_lines(rows, min_chars, min_docs).groupBy("doc", "fp").agg(F.collect_list("lines").alias("lines"))
    line_count = F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit(""))) + 1
    counts = rows.select("doc", F.xxhash64("body").alias("fp"), line_count.cast("long").alias("n_lines")).distinct()
    return counts.join(drops, ["doc", "fp"], "left").mapInArrow(_bitmaps, BITMAPS)


def kept_text(text: str, keep_bitmap: bytes, n_lines: int) -> str:
    """Apply a bitmap to the text it was made for."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), count=n_lines)
    if keep.all():
        return text
    return "\n".join(x for x, k in zip(text.split("\n"), keep.tolist(), strict=True) if k)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join bitmaps to every row of ``docs``: ``row`` (its other columns by place), ``body`` and the bitmap's columns."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    was_null = F.when(F.col(f"`{text_col}`").isNull(), True).alias("was_null")
    others = F.struct(*others, was_null).alias("row")
    rows = docs.select(*document_columns(id_col, text_col), others).withColumn("fp", F.xxhash64("body"))
    return rows.join(bitmaps.hint("shuffle_hash"), ["doc", "fp"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [
            hashlib.sha256(kept_text(t, b, n).encode()).hexdigest()
            for t, b, n in zip(*(batch[c].to_pylist() for c in ("body", "keep_bitmap", "n_lines")), strict=True)
        ]
        columns = [batch["doc"], batch["n_lines"], batch["n_dropped"], pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n_lines", "n_dropped", "kept_sha256"])


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """One row for each row of ``docs``: id, lines, dropped lines and the digest of the kept text."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **rule), id_col, text_col)
    rows = joined.select("doc", "body", "n_lines", "n_dropped", "keep_bitmap")
    digests = rows.mapInArrow(_digests, "doc long, n_lines long, n_dropped long, kept_sha256 string")
    return digests.select(outer_id().alias(id_col), "n_lines", "n_dropped", "kept_sha256")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """Return ``docs`` with its columns, the text without the dropped lines (a null text stays null)."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **rule), id_col, text_col)
    joined = joined.select("row", F.when(F.col("row.was_null").isNull(), F.col("body")).alias("text"), "n_lines", "n_dropped", "keep_bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("text", "keep_bitmap", "n_lines", "n_dropped")]
            texts = [kept_text(t, b, n) if d else t for t, b, n, d in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string())], ["row", "text"])

    cut = joined.mapInArrow(run, T.StructType([joined.schema["row"], joined.schema["text"]]))
    places = {c: i for i, c in enumerate(docs.columns)}
    return cut.select(*[F.col("text" if c == text_col else f"row.c{i}").alias(c) for c, i in places.items()])
