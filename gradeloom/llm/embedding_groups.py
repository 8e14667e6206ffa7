"""Groups of near copies among vectors, by cells of a spherical k-means.

Directions of a bounded sample fix the centres of the cells. A vector has the cell of its
nearest centre as its home and is a guest in every cell that may be the home of a vector close
enough: if u (home a) and v (home b) differ by at most d, then the leads of b over a for v
and of a over b for u add up to (u - v)(c_a - c_b) <= d |c_a - c_b|, so in one of the two
directions the lead is at most half of that. Cells are compared in blocks: homes with
homes and with guests, by products of matrices.

Equal vectors are one row with a count from the start. Groups of near copies that hold a
large part of the sample are balls: vectors within half the angle of a pivot are linked
with one another by the triangle inequality, so they are counted and never compared.
Neither pairs nor groups are collected; a block gives link counts and as many links as
connect its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import streams
from gradeloom.llm.common import NULL_ID, outer_id
from gradeloom.llm.components import components
from gradeloom.llm.word_tokens import release_memory
from gradeloom.session import cut_lineage

SAMPLE_ROWS = 20_000  # vectors that centres and pivots are fitted on, and numbers in them
SAMPLE_NUMBERS = 8_000_000
CELLS = 4096  # cells at most, and numbers in their centres
CENTRE_NUMBERS = 2_000_000
ROUNDS = 8  # of the k-means
BALL_SHARE = 1 / 200  # part of the sample that makes a pivot
BLOCK_NUMBERS = 2_000_000  # numbers in the vectors of a block
TILE = 1024  # rows of a product of matrices
SLACK = 1e-4  # products in single precision differ by less; what is closer to the threshold is done again


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions of vectors, also of very long and very short ones."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_centres(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of directions; the first centres are spread over the sample in its order."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        home = np.concatenate([(sample[i : i + TILE] @ centres.T).argmax(axis=1) for i in range(0, len(sample), TILE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.linalg.norm(sums, axis=1)
        full = length > 1e-9  # an empty cell keeps its centre
        centres = np.where(full[:, None], sums / np.where(full, length, 1)[:, None], centres)
    return centres


def fit_pivots(sample: np.ndarray, centres: np.ndarray, inner: float, least: int) -> np.ndarray:
    """Directions that have ``least`` vectors of the sample within a cosine of ``inner``, the densest of each cell first."""
    home = np.concatenate([(sample[i : i + TILE] @ centres.T).argmax(axis=1) for i in range(0, len(sample), TILE)])
    pivots = []
    for cell in np.flatnonzero(np.bincount(home, minlength=len(centres)) >= least):
        rows = sample[home == cell]
        while len(rows) >= least:
            near = np.concatenate([(rows[i : i + TILE] @ rows.T >= inner).sum(axis=1) for i in range(0, len(rows), TILE)])
            if near.max() < least:
                break
            seed = rows[near.argmax()]
            pivot = unit(rows[rows @ seed >= inner].sum(axis=0, keepdims=True))[0]
            close = rows @ pivot >= inner
            if close.sum() < least:
                pivot, close = seed, rows @ seed >= inner
            pivots.append(pivot)
            rows = rows[~close]
    return np.array(pivots).reshape(-1, sample.shape[1])


class Layout:
    """Centres and pivots of vectors of one length, and who visits which cell."""

    def __init__(self, centres: np.ndarray, pivots: np.ndarray, threshold: float, spread: float | None):
        self.centres, self.pivots = centres, pivots
        self.inner = math.cos(math.acos(threshold) / 2) + 1e-9
        apart = math.sqrt(2 - 2 * threshold)
        part = 1.0 if spread is None else min(1.0, spread / math.sqrt(centres.shape[1]))
        gaps = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        self.margins = gaps * (apart * part / 2) + 1e-9

    def place(self, directions: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Home, all cells in order, and ball (-1: none) of each direction."""
        scores = directions @ self.centres.T
        home = scores.argmax(axis=1)
        leads = scores[np.arange(len(home)), home][:, None] - scores
        row, cell = np.nonzero(leads <= self.margins[home])
        cells = np.split(cell, np.searchsorted(row, np.arange(1, len(home))))
        ball = np.full(len(home), -1)
        if len(self.pivots):
            near = directions @ self.pivots.T
            best = near.argmax(axis=1)
            ball = np.where(near.max(axis=1) >= self.inner, best, -1)
        return home, cells, ball


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _place(layouts: dict[int, Layout]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells and ball of each vector; vectors of a length that the sample lacks share one cell."""
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                step = max(1, BLOCK_NUMBERS // max(dim, len(layouts[dim].centres) if dim in layouts else 1))
                for i in range(0, rows.num_rows, step):
                    part = rows.slice(i, step)
                    if dim in layouts:
                        home, cells, ball = layouts[dim].place(unit(_matrix(part["vec"])))
                    else:
                        home, ball = np.zeros(part.num_rows, int), np.full(part.num_rows, -1)
                        cells = [np.zeros(1, int)] * part.num_rows
                    columns = [part["key"], pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(ball, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "home", "cells", "ball"])

    return run


UNIT = ["dim", "cell", "part1", "part2"]


class _Block:
    """One side of a unit: directions in single and double precision and what counting needs."""

    def __init__(self, rows: pa.Table):
        self.key, self.vertex = rows["key"].to_numpy(), rows["vertex"].to_numpy()
        self.exact = unit(_matrix(rows["vec"].combine_chunks())) if rows.num_rows else np.zeros((0, 1))
        self.rough = self.exact.astype(np.float32)
        self.weight, self.home, self.ball = (rows[c].to_numpy() for c in ("weight", "home", "ball"))
        self.at_home = self.home == rows["cell"].to_numpy()
        cells = rows["cells"].combine_chunks()
        visits = np.stack((np.repeat(np.arange(rows.num_rows), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()), axis=1)
        self.visits = visits
        self.links = np.zeros(rows.num_rows, np.int64)

    def visiting(self, n_cells: int) -> np.ndarray:
        found = np.zeros((len(self.key), n_cells), bool)
        found[self.visits[:, 0], self.visits[:, 1]] = True
        return found


def _linked(a: _Block, b: _Block, x: slice, y: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of pairs at or above the threshold, decided in double precision."""
    product = a.rough[x] @ b.rough[y].T
    i, j = np.nonzero(product >= threshold - SLACK)
    near = product[i, j] < threshold + SLACK
    i, j = i + x.start, j + y.start
    sure = np.ones(len(i), bool)
    sure[near] = (a.exact[i[near]] * b.exact[j[near]]).sum(axis=1) >= threshold
    return i[sure], j[sure]


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each unit: link counts of its rows, and links that connect what its pairs connect."""
        for rows in streams.groups(batches, UNIT):
            part, part1, part2 = rows["part"].to_numpy(), rows["part1"][0].as_py(), rows["part2"][0].as_py()
            a = _Block(rows.filter(pa.array(part == part1)))
            b = a if part1 == part2 else _Block(rows.filter(pa.array(part == part2)))
            blocks = [a] if a is b else [a, b]
            n_cells = 1 + max(int(max(x.visits[:, 1].max(initial=0), x.home.max(initial=0))) for x in blocks)
            a_visits, b_visits = (x.visiting(n_cells) for x in (a, b))
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                while x in parent:
                    if parent[x] in parent:
                        parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for p in range(0, len(a.key), TILE):
                for q in range(p if a is b else 0, len(b.key), TILE):
                    x, y = slice(p, min(p + TILE, len(a.key))), slice(q, min(q + TILE, len(b.key)))
                    i, j = _linked(a, b, x, y, threshold)
                    fits = (a.at_home[i] | b.at_home[j]) & ((a.ball[i] < 0) | (a.ball[i] != b.ball[j]))
                    if a is b:
                        fits &= i < j
                    i, j = i[fits], j[fits]
                    # A pair that meets in two cells counts for each of its rows at that row's home.
                    twice = (a.home[i] != b.home[j]) & a_visits[i, b.home[j]] & b_visits[j, a.home[i]]
                    for one, other, m, n in ((a, b, i, j), (b, a, j, i)):
                        counts = one.at_home[m] | ~twice
                        np.add.at(one.links, m[counts], other.weight[n[counts]])
                    for u, v in _spanning(a.vertex[i], b.vertex[j]):
                        u, v = find(u), find(v)
                        if u != v:
                            parent[max(u, v)] = min(u, v)
            for block in blocks:
                some = block.links > 0
                yield _report(block.key[some], block.links[some], None)
            if parent:
                ends = np.array([(u, find(u)) for u in parent], np.int64)
                yield _report(ends[:, 0], np.zeros(len(ends), np.int64), ends[:, 1])
        release_memory()

    return run


def _spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the links of a tile connect: hooks to the least neighbour until nothing moves."""
    if not len(u):
        return []
    names, places = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y = places[: len(u)], places[len(u) :]
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[x], least[y])
        new = least.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(names)))
    return list(zip(names[moved].tolist(), names[least[moved]].tolist(), strict=True))


def _report(key: np.ndarray, links: np.ndarray, to: np.ndarray | None) -> pa.RecordBatch:
    to = pa.nulls(len(key), pa.int64()) if to is None else pa.array(to)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(links), to], ["key", "links", "to"])


def fit(classes: DataFrame, counted: dict[int, int], threshold: float, spread: float | None, sample_rows: int) -> dict[int, Layout]:
    """Centres and pivots for each length of vectors, on a bounded sample drawn by hashes."""
    total = sum(counted.values())
    numbers = max(counted)
    wanted = min(sample_rows, max(200, SAMPLE_NUMBERS // numbers))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30)) < math.ceil((1 << 30) * wanted / total))
    sample = drawn.select("dim", "key", "vec").orderBy("dim", "key").toArrow()
    dims = sample["dim"].to_numpy()
    layouts = {}
    for dim in np.unique(dims).tolist():
        rows = unit(_matrix(sample.filter(pa.array(dims == dim))["vec"].combine_chunks()))
        cells = min(len(rows), CELLS, max(1, CENTRE_NUMBERS // dim), math.ceil(math.sqrt(counted[dim]) / 4))
        centres = fit_centres(rows, cells)
        inner = math.cos(math.acos(threshold) / 2) + 1e-9
        pivots = fit_pivots(rows, centres, inner, max(50, math.ceil(len(sample) * BALL_SHARE)))
        layouts[dim] = Layout(centres, pivots, threshold, spread)
    return layouts


def _units(placed: DataFrame) -> DataFrame:
    """Each vector once for every unit (two parts of a cell) that it is compared in.

    A part holds a bounded number of rows. The rows of a ball that fill parts of their own
    in a cell need no unit with parts of the same ball.
    """
    rows = placed.select("*", F.explode("cells").alias("cell"))
    most = F.greatest(F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")), F.lit(1))
    sizes = rows.groupBy("dim", "cell", "ball").agg(F.count("*").alias("n"), (F.count("*") > F.first(most)).alias("large"))
    own = F.when(F.col("large"), F.col("ball")).otherwise(F.lit(-1))
    kinds = sizes.groupBy("dim", "cell", own.alias("kind")).agg(F.ceil(F.sum("n") / F.first(most)).cast("int").alias("n_parts"))
    listed = kinds.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("kind", "n_parts"))).alias("kinds"))
    listed = cut_lineage(listed)  # a row for each cell, with a struct for each large ball in it
    rows = rows.join(listed, ["dim", "cell"])
    mine = F.array_contains("kinds.kind", F.col("ball"))
    kind = F.when(mine, F.col("ball")).otherwise(F.lit(-1))
    rows = rows.withColumn("kind", kind)
    parts = F.flatten(
        F.transform("kinds", lambda k: F.transform(F.sequence(F.lit(0), k["n_parts"] - 1), lambda i: F.struct(k["kind"].alias("kind"), i.alias("i"))))
    )
    rows = rows.withColumn("parts", parts)
    n_parts = F.aggregate(F.filter("kinds", lambda k: k["kind"] == F.col("kind")), F.lit(0), lambda n, k: n + k["n_parts"])
    i = F.pmod(F.xxhash64("key"), n_parts).cast("int")
    rows = rows.withColumn("part", (F.array_position("parts", F.struct(F.col("kind"), i.alias("i"))) - 1).cast("int"))
    other = F.filter(
        F.transform("parts", lambda p, k: F.struct(k.alias("at"), p["kind"].alias("kind"))),
        lambda p: (p["kind"] != F.col("kind")) | (F.col("kind") == -1),
    )
    rows = rows.withColumn("other", F.explode(F.transform(other, lambda p: p["at"])))
    part1, part2 = F.least("part", "other").alias("part1"), F.greatest("part", "other").alias("part2")
    return rows.select("dim", "cell", part1, part2, "part", "key", "vertex", "vec", "weight", "home", "cells", "ball")


def near_copies(
    vectors: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    spread: float | None = 4.0,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Links between vectors with a cosine of ``threshold`` or more, and one vector to keep of each group.

    Returns for each row the id, ``n_links`` (other rows linked directly), ``component_id`` (the
    smallest id that links lead to, its own included) and ``kept`` (whether the two ids are equal).
    A vector that is null, empty or zero or that holds a null, an infinity or a NaN is linked
    with nothing, and so are vectors of different lengths. Rows are counted one by one, also
    those that repeat an id or a vector. A null id is the smallest; a group that holds one has
    a null component. An empty table gives no rows.

    No link below the threshold (0 < threshold < 1, in double precision) is made. With ``spread``
    None every link is found. Otherwise a vector is a guest only where a partner can be whose
    difference, as a random direction, lies within so many standard deviations along the line
    of two centres; 4 loses about three pairs in 100,000 that are exactly at the threshold
    and fewer above it, and none at all in up to 16 dimensions.

    Cells are fitted on about ``sample_rows`` distinct vectors; every vector is indexed.
    """
    i, v = F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")
    if v_type(vectors, vector_col) not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    rows = vectors.select(F.coalesce(i.cast("long"), F.lit(NULL_ID)).alias("doc"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number but two hashes.
    vec = F.transform("vec", lambda x: x + F.lit(0.0).cast("float")) if v_type(rows, "vec") == "array<float>" else F.transform("vec", lambda x: x + 0.0)
    rows = rows.select("doc", F.when(usable, vec).alias("vec"))
    rows = rows.select("doc", "vec", F.xxhash64("vec").alias("key"), F.xxhash64(F.lit("second"), "vec").alias("key2"))
    classes = rows.where("vec IS NOT NULL").groupBy("key", "key2").agg(
        F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("doc").alias("least")
    )
    classes = cut_lineage(classes.select("key", F.size("vec").alias("dim"), "vec", "weight", "least"))
    counted = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # lengths of vectors
    answer = [outer_id().alias(id_col), "n_links", outer_id("root").alias("component_id")]
    if not counted:
        return rows.select("doc", F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("root")).select(*answer, F.lit(True).alias("kept"))
    layouts = fit(classes, counted, threshold, spread, sample_rows)
    spots = classes.select("key", "dim", "vec").mapInArrow(_place(layouts), "key long, home int, cells array<int>, ball int")
    placed = cut_lineage(classes.join(spots, "key"))
    # A row for each pivot. In the links a ball is one vertex, its smallest key.
    balls = placed.where("ball >= 0").groupBy("dim", "ball")
    balls = cut_lineage(balls.agg(F.sum("weight").alias("in_ball"), F.min("key").alias("vertex"), F.min("least").alias("of_ball")))
    vertices = placed.join(F.broadcast(balls), ["dim", "ball"], "left").withColumn("vertex", F.coalesce("vertex", "key"))
    units = _units(vertices).repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = cut_lineage(units.mapInArrow(_compare(threshold), "key long, links long, to long"))

    below = components(found.where("to IS NOT NULL").select(F.col("key").alias("u"), F.col("to").alias("v")))
    below = below.select(F.col("v").alias("key"), F.col("root").alias("top"))
    tops = cut_lineage(below.unionByName(below.select(F.col("top").alias("key"), "top").distinct()))
    least = placed.select("key", "least").unionByName(balls.select(F.col("vertex").alias("key"), F.col("of_ball").alias("least")))
    least = least.join(tops, "key").groupBy("top").agg(F.min("least").alias("root"))
    roots = cut_lineage(tops.join(least, "top").select("key", "root"))
    balls = balls.join(roots.withColumnRenamed("key", "vertex"), "vertex", "left")
    balls = balls.select("dim", "ball", "in_ball", F.coalesce("root", "of_ball").alias("ball_root"))
    links = found.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    summed = placed.select("key", "dim", "ball", "weight", "least").join(links, "key", "left").join(roots, "key", "left")
    summed = summed.join(F.broadcast(balls), ["dim", "ball"], "left")
    n_links = (F.coalesce("in_ball", "weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    summed = cut_lineage(summed.select("key", n_links, F.coalesce("ball_root", "root", "least").alias("root")))
    joined = rows.select("doc", F.when(F.col("vec").isNotNull(), F.col("key")).alias("key")).join(summed, "key", "left")
    joined = joined.select("doc", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "doc").alias("root"))
    return joined.select(*answer, (F.col("doc") == F.col("root")).alias("kept"))


def v_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
