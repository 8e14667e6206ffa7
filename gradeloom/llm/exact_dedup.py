"""Exact deduplication against an immutable snapshot.

A snapshot is stored as exact buckets of digests with one static binary-fuse filter
for each bucket (Graf and Lemire, "Binary Fuse Filters", 2022). Digests of a new batch
are first grouped among themselves, so a group of copies is one row before anything is
compared, and then screened by the filters. Only positives go on to the exact buckets.
Members of a group are at last compared byte by byte with the row that stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACES, documents, outer_id
from gradeloom.session import cut_lineage

# Digests of one bucket: the most that a task holds while it builds or asks a filter.
BUCKET_KEYS = 250_000
MIN_BUCKETS = 64
# Members of a group that are compared with one copy of the row that stays.
MEMBERS_PER_COPY = 500


# --- the filter ---------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of MurmurHash3 over key + seed (its two factors are fixed values)."""
    h = keys.astype(np.uint64) + np.uint64(seed)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """Static set of 64-bit keys: no false negatives, about one false positive in 256."""

    seed: int
    segment: int  # slots of a segment, a power of two
    segments: int  # segments in which a key's first slot may lie
    prints: np.ndarray  # uint8

    @staticmethod
    def _shape(n: int) -> tuple[int, int]:
        segment = 2 ** max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        return segment, max(1, math.ceil(n * factor / segment) - 2)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three slots in neighbouring segments (3 x n) and the print of each key."""
        h = _mix(keys, self.seed)
        mask = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segment * self.segments)) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        segment, segments = cls._shape(len(keys))
        for attempt in range(1, 200):
            if attempt % 20 == 0:
                segments += 1 + segments // 8
            built = cls(attempt * 0x9E3779B97F4A7C15 % 2**64, segment, segments, np.zeros(segment * (segments + 2), np.uint8))
            if built._fill(keys):
                return built
        raise RuntimeError("no seed gives a filter")

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel keys that are alone in a slot, round by round, then assign prints backwards."""
        places, prints = self._places(keys)
        size, index = len(self.prints), np.arange(len(keys))
        count = np.bincount(places.ravel(), minlength=size)
        alone = np.zeros(size, np.int64)  # xor of the keys in a slot: the key itself where there is one
        for slots in places:
            np.bitwise_xor.at(alone, slots, index)
        rounds, left, candidates = [], len(keys), np.flatnonzero(count == 1)
        while len(candidates):
            peeled, at = np.unique(alone[candidates], return_index=True)
            rounds.append((peeled, candidates[at]))
            left -= len(peeled)
            touched = places[:, peeled].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(alone, touched, np.tile(peeled, 3))
            touched = np.unique(touched)
            candidates = touched[count[touched] == 1]
        if left:
            return False
        for peeled, slots in reversed(rounds):
            mine = places[:, peeled]
            others = np.bitwise_xor.reduce(self.prints[mine], axis=0) ^ self.prints[slots]
            self.prints[slots] = prints[peeled] ^ others
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys.astype(np.uint64))
        return np.bitwise_xor.reduce(self.prints[places], axis=0) == prints


# --- digests and groups -------------------------------------------------------------


def normalised(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACES, "")


def digests(rows: DataFrame) -> DataFrame:
    """One row for each distinct (id, text): ``doc, fp, n_chars, sha, h`` and ``repeats``, its rows."""
    found = rows.select(
        "doc",
        F.xxhash64("body").alias("fp"),
        F.char_length("body").cast("long").alias("n_chars"),
        F.unhex(F.sha2(normalised(F.col("body")), 256)).alias("sha"),
    )
    return found.groupBy("doc", "fp", "n_chars", "sha").agg(F.xxhash64("sha").alias("h"), F.count("*").alias("repeats"))


def groups(found: DataFrame) -> DataFrame:
    """Copies as one row: ``sha, h, n`` and ``best``, the row that stays."""
    rank = F.struct(F.col("n_chars"), F.bitwise_not("doc").alias("order"), F.col("doc"), F.col("fp"))
    return found.groupBy("sha", "h").agg(F.sum("repeats").alias("n"), F.max(rank).alias("best"))


@dataclass
class Snapshot:
    exact: DataFrame  # sha, h, n, best, bucket
    filters: DataFrame  # bucket, seed, segment, segments, prints
    n_buckets: int


def bucket(h: str, n_buckets: int) -> Column:
    return F.pmod(F.col(h), F.lit(n_buckets)).cast("int").alias("bucket")


def _filter_of(group: pa.Table) -> pa.Table:
    built = FuseFilter.build(group["h"].to_numpy().view(np.uint64))
    return pa.table(
        {
            "bucket": pa.array([group["bucket"][0].as_py()], pa.int32()),
            "seed": pa.array([str(built.seed)], pa.string()),
            "segment": pa.array([built.segment], pa.int32()),
            "segments": pa.array([built.segments], pa.int32()),
            "prints": pa.array([built.prints.tobytes()], pa.binary()),
        }
    )


def take_snapshot(found: DataFrame, n_buckets: int) -> Snapshot:
    """Store digests as exact buckets and build a filter for each bucket."""
    exact = cut_lineage(groups(found).select("*", bucket("h", n_buckets)))
    schema = "bucket int, seed string, segment int, segments int, prints binary"
    filters = cut_lineage(exact.select("bucket", "h").groupBy("bucket").applyInArrow(_filter_of, schema))
    return Snapshot(exact, filters, n_buckets)


def _ask(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    if filters.num_rows and incoming.num_rows:
        f = filters.to_pylist()[0]
        built = FuseFilter(int(f["seed"]), f["segment"], f["segments"], np.frombuffer(f["prints"], np.uint8))
        hit = built.contains(incoming["h"].to_numpy().view(np.uint64))
    else:
        hit = np.zeros(incoming.num_rows, bool)
    return pa.table({"sha": incoming["sha"], "hit": pa.array(hit)})


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Ask the filters: ``sha, hit`` for each group of the batch."""
    keyed = batch.select("sha", "h", bucket("h", snapshot.n_buckets)).groupBy("bucket")
    return keyed.cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(_ask, "sha binary, hit boolean")


def merge_batch(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Groups over snapshot and batch: ``sha, n, best``."""
    screened = batch.join(screen(batch, snapshot), "sha")
    columns = ["sha", "n", "best"]
    positives = screened.where("hit").select(*columns).unionByName(snapshot.exact.select(*columns))
    merged = positives.groupBy("sha").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    return screened.where("not hit").select(*columns).unionByName(merged)


def check_bytes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Compare each member of a group with the row that stays; an inequality is an error.

    ``members`` has ``doc, fp, sha, n`` and ``keep_doc, keep_fp``. The row that stays is
    copied once for every MEMBERS_PER_COPY members, so a group of any size is spread.
    """
    copies = F.ceil(F.col("n") / MEMBERS_PER_COPY).cast("int")
    texts = rows.select("doc", F.xxhash64("body").alias("fp"), normalised(F.col("body")).alias("norm")).join(
        members.hint("shuffle_hash"), ["doc", "fp"]
    )
    # Written once: the members and the rows that stay are both read from it.
    texts = cut_lineage(texts.withColumn("part", F.pmod(F.xxhash64("doc", "fp"), copies)))
    stays = (F.col("doc") == F.col("keep_doc")) & (F.col("fp") == F.col("keep_fp"))
    kept = texts.where(stays).dropDuplicates(["sha"]).select(
        "sha", F.col("norm").alias("keep_norm"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("part")
    )
    same = texts.join(kept, ["sha", "part"]).select(
        *members.columns, F.expr("if(norm = keep_norm, true, raise_error('two texts have one SHA-256'))").alias("same")
    )
    return same.where("same").select(*members.columns).distinct()


def resolve(docs: DataFrame, in_snapshot: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find copies over a snapshot and a new batch that together are ``docs``.

    ``in_snapshot`` is a condition on the internal id ``doc`` that splits the documents.
    Texts are equal when they are identical without white space; a null text is empty
    and all empty texts are equal. Of a group the row with the most code points in its
    text stays, then the one with the smallest id (a null id is the smallest). Rows that
    repeat an id, with the same or another text, are rows of their own; of rows that repeat
    id and text one can stay. An empty table gives no rows.

    Returns for each row ``doc_id`` (named as ``id_col``), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    """
    rows = documents(docs, id_col, text_col)
    found = cut_lineage(digests(rows))
    n_buckets = max(MIN_BUCKETS, math.ceil(found.count() / BUCKET_KEYS))
    snapshot = take_snapshot(found.where(in_snapshot), n_buckets)
    batch = cut_lineage(groups(found.where(~in_snapshot)))
    merged = merge_batch(batch, snapshot).select(
        "sha", "n", F.col("best.doc").alias("keep_doc"), F.col("best.fp").alias("keep_fp")
    )
    resolved = cut_lineage(found.select("doc", "fp", "sha", "repeats").join(merged, "sha"))
    members = check_bytes(rows, resolved.where("n > 1"))
    everything = resolved.where("n = 1").unionByName(members.select(*resolved.columns))
    stays = (F.col("doc") == F.col("keep_doc")) & (F.col("fp") == F.col("keep_fp"))
    everything = everything.select("*", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repeat"))
    return everything.select(
        outer_id().alias(id_col),
        outer_id("keep_doc").alias("keep_id"),
        F.col("n").alias("group_size"),
        (stays & (F.col("repeat") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
