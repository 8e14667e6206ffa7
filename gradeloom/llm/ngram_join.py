"""Jaccard join of word-shingle sets by signature trees.

Documents with equal sets are one representative. Representatives that can be similar
enough meet in a root: the shingles of a set are dealt into groups by hash, the shingles in
which two similar sets differ touch fewer groups than each of them lists, so one listed
group is equal in both (see ``Keys``). A root's documents, in parts of bounded size if
they are many, become signature trees: a node holds the OR of the token bitmaps below it
and their range of sizes. Two trees are traversed together; a pair of nodes goes when the
largest overlap that it can have is too small. The trees are traversed twice: first with
the bitmaps alone, which leaves documents out of a root where no other can be similar
enough, then with the sets of those that are left, whose pairs are compared exactly. Between
the two, what can be similar is put together: documents that such pairs connect are one
group, so a set travels once for its group, however many roots its document is in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import streams
from gradeloom.llm.common import document_columns, documents, outer_id, row_key
from gradeloom.llm.components import components
from gradeloom.llm.shingles import WordHashes, mix, shingle_sets
from gradeloom.llm.word_tokens import release_memory
from gradeloom.session import Scratch, cut_lineage

# A group with more shingles or documents than this is compared in parts of about this size.
PART_SHINGLES = 200_000
PART_DOCS = 400
PART_MAPS = 2000  # documents of a part of a root while only bitmaps are compared
# Places of documents that may be broadcast (28 bytes each); texts meet more of them by a shuffle.
BROADCAST_DOCS = 1_000_000
LEAF = 16  # documents of a leaf
FANOUT = 8  # children of a node


class Keys:
    """Keys of which two sets share one if their Jaccard coefficient is at least share = a / b.

    Sets of n and m >= n shingles differ in at most n (1 - t) / t of them. A set lists the
    first so many and one of its non-empty groups, in the order of the groups: of those,
    one at least holds no differing shingle, and the first such group is listed by both. A
    scheme fixes the number of groups for a range of sizes; sets near its upper end are
    listed in the next one too. Below, where a set has at most one shingle more than the
    other, a set is listed as a whole and without each of its shingles.

    That needs more non-empty groups than differing shingles in one of the two sets. A set
    that has too few also lists so many of its first shingles in the order of their hashes;
    of two such sets the first common shingle is among those of both.
    """

    def __init__(self, above: int, below: int):
        self.above, self.below = above, below
        self.t = above / below
        self.base = self.first_with(2)  # smallest size that may differ in two shingles
        self.range = self.t**-4

    def differing(self, n: int) -> int:
        return n * (self.below - self.above) // self.above

    def first_with(self, d: int) -> int:
        return -(-d * self.above // (self.below - self.above)) if self.above < self.below else 2**62

    def schemes(self, n: int) -> list[tuple[int, int]]:
        """Schemes in which a set of size n is listed, with their numbers of groups."""
        if n < self.base:
            return []
        k = int(math.log(n / self.base) / math.log(self.range) + 1e-9)
        found = [k]
        if n >= self.t * self.base * self.range ** (k + 1) - 1:
            found.append(k + 1)
        return [(i, math.ceil(1.25 * (self.differing(math.ceil(self.base * self.range ** (i + 1))) + 1)) + 8) for i in found]

    def of(self, found: np.ndarray) -> np.ndarray:
        n = len(found)
        out = []
        if n and self.differing(n) and n * self.above <= (self.base - 1) * self.below:
            hashes = mix(found, 11)
            whole = hashes.sum(dtype=np.uint64)
            out.append(mix(np.append(whole - hashes, whole), 12))
        if n >= self.base:
            value, place = mix(found, 13), mix(found, 14) >> np.uint64(32)
            for scheme, n_groups in self.schemes(n):
                group = (place * np.uint64(n_groups)) >> np.uint64(32)
                order = np.argsort(group, kind="stable")
                group = group[order]
                starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                if len(starts) <= self.differing(n):
                    out.append(mix(found[: self.differing(n) + 1], 15))
                sums = np.add.reduceat(value[order], starts) + group[starts]
                out.append(mix(sums[: self.differing(n) + 1], 100 + scheme))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _describe(width: int, keys: Keys) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            sizes, listed, maps, s1, s2 = [], [], [], [], []
            for found in shingle_sets(batch["body"], width, table):
                sizes.append(len(found))
                s1.append(mix(found, 21).sum(dtype=np.uint64))
                s2.append(mix(found, 22).sum(dtype=np.uint64))
                listed.append(keys.of(found))
                maps.append(bitmap(found).tobytes())
            hashes = [pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2)]
            columns = [batch["doc"], batch["fp"], pa.array(sizes, pa.int32()), *hashes]
            columns += [_list_array(listed), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "fp", "n", "s1", "s2", "keys", "map"])
        table.forget()
        release_memory()

    return run


def describe(rows: DataFrame, width: int, keys: Keys) -> DataFrame:
    """Of each row: ``doc, fp`` (hash of the text), ``n`` (size of the set), ``s1, s2`` (its hash), ``keys, map``."""
    schema = "doc long, fp long, n int, s1 long, s2 long, keys array<long>, map binary"
    return rows.select("doc", F.xxhash64("body").alias("fp"), "body").mapInArrow(_describe(width, keys), schema)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by key and document: each document with the first one of its key.

    The first and last key of the partition can go on in another one; those are reported.
    """
    key = root = None
    first = True
    names = ["kind", "key", "root", "doc"]

    def rows(kind: str, keys: np.ndarray, roots: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), *map(pa.array, (keys, roots, docs))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        k, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.concatenate(([key is None or k[0] != key], k[1:] != k[:-1]))
        starts = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: goes on from the batch before
        roots = np.concatenate(([root if root is not None else 0], d[starts]))[run]
        if first:
            edge = starts[:1] if key is None else starts[:0]
            yield rows("part", k[edge], d[edge], d[edge])
            first = False
        linked = roots != d
        yield rows("pair", k[linked], roots[linked], d[linked])
        key, root = k[-1], roots[-1]
    if key is not None:
        yield rows("part", np.array([key]), np.array([root]), np.array([root]))


def meeting(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Roots and their documents, ``root, doc`` with root < doc, for all keys that documents share."""
    listed = reps.select(F.explode("keys").alias("key"), "doc")
    ranged = listed.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc")
    streamed = scratch.cut(ranged.mapInArrow(_roots, "kind string, key long, root long, doc long"))
    # Two rows a partition at most: the parts of a key that was cut are put under its first document.
    parts = streamed.where("kind = 'part'").groupBy("key").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    joined = parts.select("key", "root", F.explode("roots").alias("part")).where("root <> part")
    pairs = streamed.where("kind = 'pair'").select("key", "root", "doc")
    moved = joined.select("key", F.col("part").alias("doc"), "root")
    under = pairs.join(
        F.broadcast(joined.select("key", F.col("part").alias("root"), F.col("root").alias("over"))), ["key", "root"], "left"
    ).select(F.coalesce("over", "root").alias("root"), "doc")
    return under.unionByName(moved.select("root", "doc")).where("root <> doc").distinct()


# --- signature trees ----------------------------------------------------------------


def bitmap(found: np.ndarray) -> np.ndarray:
    """Token bitmap of a set: a power of two of 64-bit words, about two bits for a shingle."""
    words = 2 ** min(9, max(2, math.ceil(math.log2(max(1, len(found) / 32)))))
    h = mix(found, 31)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (h % np.uint64(words)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58)))
    return out


class SignatureTree:
    """Documents by size; each level holds OR-combined bitmaps, size ranges and hidden tokens.

    A document's hidden tokens are those that share a bit with another of its tokens. A
    bitmap narrower than the widest is repeated, so a token has its bit in it anyway; a
    level also holds the words after which a bitmap repeats, as a bit counts only once.
    """

    def __init__(self, maps: list[np.ndarray], sizes: list[int]):
        self.order = np.array(sorted(range(len(maps)), key=lambda i: sizes[i]), np.int64)
        size = np.array(sizes, np.int64)[self.order]
        hidden = size - np.array([int(np.bitwise_count(m).sum()) for m in maps], np.int64)[self.order]
        widths = np.array([len(m) for m in maps], np.int64)[self.order]
        width = int(widths.max())
        tiled = np.stack([np.tile(maps[i], width // len(maps[i])) for i in self.order])
        self.levels = [(tiled, size, size, hidden, widths)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            level, low, *most = self.levels[-1]
            at = np.arange(0, len(level), step)
            self.levels.append((np.bitwise_or.reduceat(level, at), low[at], *[np.maximum.reduceat(x, at) for x in most]))
            step = FANOUT

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = LEAF if level == 1 else FANOUT
        return node * step, np.minimum((node + 1) * step, len(self.levels[level - 1][0]))


def _possible(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, above: int, below: int) -> np.ndarray:
    """Node pairs whose largest possible overlap is enough for their smallest sizes."""
    keep = np.zeros(len(x), bool)
    for i in range(0, len(x), 4096):
        p, q = x[i : i + 4096], y[i : i + 4096]
        p_maps, q_maps = a[0][p], b[0][q]
        if p_maps.shape[1] != q_maps.shape[1]:
            width = max(p_maps.shape[1], q_maps.shape[1])
            p_maps, q_maps = (np.tile(m, (1, width // m.shape[1])) for m in (p_maps, q_maps))
        shared = np.bitwise_count(p_maps & q_maps).sum(axis=1, dtype=np.int64)
        shared //= p_maps.shape[1] // np.maximum(a[4][p], b[4][q])
        most = np.minimum(np.minimum(a[2][p], b[2][q]), shared + np.minimum(a[3][p], b[3][q]))
        fits = (a[2][p] * below >= b[1][q] * above) & (b[2][q] * below >= a[1][p] * above)
        keep[i : i + 4096] = fits & (most * (above + below) >= (a[1][p] + b[1][q]) * above)
    return keep


def traverse(a: SignatureTree, b: SignatureTree, above: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents (positions in the two trees) that may be similar enough.

    Goes down depth first from the pair of the roots, so few node pairs are open at once.
    Of one tree with itself, each pair comes once.
    """
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    zero = np.zeros(1, np.int64)
    stack = [(min(top, len(a.levels) - 1), min(top, len(b.levels) - 1), zero, zero)]
    while stack:
        i, j, x, y = stack.pop()
        keep = _possible(a.levels[i], b.levels[j], x, y, above, below)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if i == j == 0:
            yield (x[x < y], y[x < y]) if same else (x, y)
            continue
        if len(x) > 64:  # so that the lists below stay short
            stack += [(i, j, x[k : k + 64], y[k : k + 64]) for k in range(0, len(x), 64)]
            continue
        next_i, next_j = (i - 1 if i >= j else i), (j - 1 if j >= i else j)
        xs, ys = [], []
        for p, q in zip(x, y, strict=True):
            ps = np.arange(*a.children(i, p)) if next_i < i else np.array([p])
            qs = np.arange(*b.children(j, q)) if next_j < j else np.array([q])
            xs.append(np.repeat(ps, len(qs)))
            ys.append(np.tile(qs, len(ps)))
        x, y = np.concatenate(xs), np.concatenate(ys)
        if same and next_i == next_j:
            x, y = x[x <= y], y[x <= y]
        stack.append((next_i, next_j, x, y))


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, above: int, below: int, spanning: bool):
    """Pairs of positions with a Jaccard coefficient of above / below or more; right None: left with itself.

    ``spanning``: only as many pairs as connect what all pairs connect.
    """
    sets = left + (right or [])
    if not left or right == []:
        return
    a = SignatureTree([bitmap(x) for x in left], [len(x) for x in left])
    b = a if right is None else SignatureTree([bitmap(x) for x in right], [len(x) for x in right])
    joined = _Union(len(sets))
    shift = 0 if right is None else len(left)
    for x, y in traverse(a, b, above, below):
        for p, q in zip(a.order[x].tolist(), (b.order[y] + shift).tolist(), strict=True):
            if spanning and joined.find(p) == joined.find(q):
                continue
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if common * below >= (len(sets[p]) + len(sets[q]) - common) * above:
                joined.parent[joined.find(p)] = joined.find(q)
                yield p, q - shift, common


# --- the join -----------------------------------------------------------------------

UNIT = ["root", "part1", "part2"]


def _deal(width: int) -> Callable:
    """The set of each document, once for each pair of parts that its part is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            sets = shingle_sets(batch["body"], width, table)
            places = (batch[c].to_pylist() for c in ("doc", "root", "part", "parts"))
            columns: list[list] = [[] for _ in range(6)]
            held = 0
            for doc, root, part, parts, found in zip(*places, sets, strict=True):
                if not len(found):  # an empty text of an id with others is similar to nothing
                    continue
                value = found.tobytes()
                for other in range(parts):
                    row = (root, min(part, other), max(part, other), part, doc, value)
                    for column, cell in zip(columns, row, strict=True):
                        column.append(cell)
                    held += len(value)
                    if held > 8_000_000:
                        yield _units(columns)
                        columns, held = [[] for _ in range(6)], 0
            yield _units(columns)
        table.forget()
        release_memory()

    return run


def _units(columns: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = [*UNIT, "part", "doc", "shingles"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _sides(unit: pa.Table) -> tuple[list[int], list[int]]:
    """Rows of the two parts of a unit, the same list twice if it is one part."""
    part = unit["part"].to_pylist()
    part1, part2 = unit["part1"][0].as_py(), unit["part2"][0].as_py()
    a = [i for i, p in enumerate(part) if p == part1]
    return a, a if part1 == part2 else [i for i, p in enumerate(part) if p == part2]


def _connected(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """As many of the pairs of n places as connect what all of them connect."""
    joined = _Union(n)
    known = np.arange(n)  # what was connected when it was last looked up
    looked = 0
    kept = []
    for x, y in pairs:
        apart = known[x] != known[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            p, q = joined.find(i), joined.find(j)
            if p != q:
                joined.parent[p] = q
                kept.append((i, j))
        looked += int(apart.sum())
        if looked > n:
            known, looked = np.array([joined.find(i) for i in range(n)]), 0
    return kept


def _hopeful(above: int, below: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of documents that connect those of a unit that can be similar enough, by their bitmaps."""
        for unit in streams.groups(batches, UNIT):
            docs = unit["doc"].to_numpy()
            maps = [np.frombuffer(m, np.uint64) for m in unit["map"].to_pylist()]
            sizes = unit["n"].to_pylist()
            a, b = _sides(unit)
            if not a or not b:
                continue
            left = SignatureTree([maps[i] for i in a], [sizes[i] for i in a])
            right = left if a is b else SignatureTree([maps[i] for i in b], [sizes[i] for i in b])
            p, q = np.array(a)[left.order], np.array(b)[right.order]
            kept = _connected(((p[x], q[y]) for x, y in traverse(left, right, above, below)), len(maps))
            ends = np.array(kept, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(docs[ends[:, k]]) for k in (0, 1)], ["u", "v"])

    return run


def _compare(above: int, below: int, spanning: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v", "common", "either"])

        for unit in streams.groups(batches, UNIT):
            docs = unit["doc"].to_pylist()
            sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
            a, b = _sides(unit)
            right = None if a is b else [sets[i] for i in b]
            found = similar_pairs([sets[i] for i in a], right, above, below, spanning)
            for x, y, common in found:
                i, j = a[x], b[y]
                rows.append((docs[i], docs[j], common, len(sets[i]) + len(sets[j]) - common))
            if len(rows) > 10_000:
                yield flush()
        yield flush()
        release_memory()

    return run


def in_parts(members: DataFrame, parts: Column, scratch: Scratch) -> DataFrame:
    """Add ``part`` of each member and ``parts`` of its root (an aggregate over the columns and rows)."""
    counted = scratch.cut(members.groupBy("root").agg(F.ceil(parts).cast("int").alias("parts")))
    placed = members.join(counted, "root")
    return placed.withColumn("part", F.pmod(F.xxhash64("doc", "root"), F.col("parts")).cast("int"))


def with_roots(members: DataFrame) -> DataFrame:
    """``root, doc`` of members and of the roots themselves."""
    return members.select("root", "doc").unionByName(members.select("root", F.col("root").alias("doc")).distinct())


def possible(reps: Callable[..., DataFrame], above: int, below: int, scratch: Scratch) -> DataFrame:
    """Groups of representatives that bitmaps do not tell apart, ``root, doc``; similar ones are in one group."""
    pairs = scratch.cut(meeting(reps("keys").where(F.size("keys") > 0), scratch))
    # Bitmaps join last: only the rows that go to their units carry them.
    placed = in_parts(with_roots(pairs), F.count("*") / PART_MAPS, scratch)
    units = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = units.select("root", F.least("part", "other").alias("part1"), F.greatest("part", "other").alias("part2"), "part", "doc")
    units = units.join(reps("map", "n").select("doc", "n", "map"), "doc").select(*UNIT, "part", "doc", "n", "map")
    units = units.repartition(*UNIT).sortWithinPartitions(*UNIT, "doc")
    hopeful = scratch.cut(units.mapInArrow(_hopeful(above, below), "u long, v long").distinct())
    return with_roots(components(hopeful).select("root", F.col("v").alias("doc")))


def links(
    rows: DataFrame, reps: Callable[..., DataFrame], width: int, above: int, below: int, scratch: Scratch, spanning: bool = True
) -> DataFrame:
    """Links between representatives: ``u, v, common, either``, all of them or enough to connect them.

    ``reps`` is an aggregate of equal sets that gives ``doc`` and the first of other columns;
    ``rows`` has the texts.
    """
    sizes = reps("n").groupBy("doc").agg(F.max("n").alias("n"))
    groups = scratch.cut(possible(reps, above, below, scratch).join(sizes, "doc"))
    parts = F.greatest(F.sum("n") / PART_SHINGLES, F.count("*") / PART_DOCS)
    places = scratch.cut(in_parts(groups, parts, scratch).select("doc", "root", "part", "parts"))  # one for a document
    met = F.broadcast(places) if places.count() <= BROADCAST_DOCS else places.hint("shuffle_hash")
    texts = rows.join(met, "doc").select("doc", "body", "root", "part", "parts")
    units = texts.mapInArrow(_deal(width), "root long, part1 int, part2 int, part int, doc long, shingles binary")
    units = units.repartition(*UNIT).sortWithinPartitions(*UNIT, "doc")
    return units.mapInArrow(_compare(above, below, spanning), "u long, v long, common long, either long")


def grouped(rows: DataFrame, width: int, above: int, below: int) -> DataFrame:
    """``doc, fp, n, root`` for each row: the smallest document that links lead to."""
    scratch = Scratch()
    described = scratch.cut(describe(rows, width, Keys(above, below)))
    found = cut_lineage(described.drop("keys", "map"))

    def representatives(*columns: str) -> DataFrame:
        same = described.where("n > 0").groupBy("s1", "s2", "n")
        return same.agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in columns if c != "n"])

    linked = cut_lineage(links(rows, representatives, width, above, below, scratch).select("u", "v"))
    reps = cut_lineage(representatives().select("s1", "s2", "doc"))
    scratch.drop()
    # A document with several texts links their representatives.
    several = found.where("n > 0").groupBy("doc").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b")
    texts = found.select("doc", "s1", "s2").join(several.select("doc"), "doc")
    again = texts.join(reps.select("s1", "s2", F.col("doc").alias("rep")), ["s1", "s2"])
    linked = linked.unionByName(again.select(F.col("rep").alias("u"), F.col("doc").alias("v")))
    roots = components(linked)
    classes = reps.select("s1", "s2", "doc").join(roots.withColumnRenamed("v", "doc"), "doc", "left")
    classes = cut_lineage(classes.select("s1", "s2", F.coalesce("root", "doc").alias("root")))
    joined = found.select("doc", "fp", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    root = F.when(F.col("n") > 0, F.coalesce("root", "doc")).otherwise(F.col("doc"))
    return joined.select("doc", "fp", "n", root.alias("root"))


def join_components(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents that are connected by similar word shingles.

    Words are runs without ASCII white space, A-Z in lower case. A document's set are its
    distinct shingles of ``width`` words; all its words if there are fewer; nothing for a
    null, empty or blank text, which is linked with nothing. Documents are linked when the
    Jaccard coefficient of their sets is at least ``threshold`` (a fraction); repeated texts
    are linked. Rows that repeat an id are one document with the links of all its texts. A
    null id is a document with the smallest id. An empty table gives no rows.

    Returns for each row the id, ``n_shingles`` and ``component_id``, the smallest id that
    links lead to, its own included.
    """
    found = grouped(documents(docs, id_col, text_col), width, *threshold)
    return found.select(
        outer_id().alias(id_col), F.col("n").cast("long").alias("n_shingles"), outer_id("root").alias("component_id")
    )


def keep_one(
    docs: DataFrame,
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
    id_col: str = "doc_id",
    text_col: str = "text",
    by_row: bool = False,
) -> DataFrame:
    """One row of ``docs`` of each group, with all its columns: the one with the smallest id.

    Of several rows with this id one stays. Documents without shingles stay. With ``by_row``
    each id and text is a document of its own: rows are linked by similar texts only, not by
    a repeated or null id.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no column of the caller clashes with the keys
    rows = docs.toDF(*names).select(
        *document_columns(names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]), *names
    )
    rows = rows.select(F.col("doc").alias("id"), row_key().alias("doc") if by_row else F.col("doc"), "body", *names)
    found = grouped(rows.select("doc", "body"), width, *threshold)
    if by_row:
        found = found.join(rows.select("doc", "id").distinct(), "doc")
    first = F.min(F.struct(F.col("id") if by_row else F.col("doc").alias("id"), "doc", "fp"))
    # Texts without shingles are linked with nothing, also not with another text of their id.
    kept = found.groupBy("root", F.when(F.col("n") == 0, F.col("fp")).alias("empty")).agg(first.alias("row"))
    kept = cut_lineage(kept.select("row.doc", "row.fp").distinct())
    rows = rows.withColumn("fp", F.xxhash64("body")).drop("body", "id")
    rows = rows.join(kept.hint("shuffle_hash"), ["doc", "fp"]).dropDuplicates(["doc", "fp"])
    return rows.select(*names).toDF(*docs.columns)
