"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector. A word's vector is the sum of the index
vectors of its neighbours over the whole corpus (Sahlgren, "An Introduction to Random
Indexing", 2005). Words are hashed into a fixed number of rows, so the table of vectors
has the same size for any corpus. A document pools the vectors of its words: their mean,
their spread and the mean distance of neighbouring words. A network of two layers turns
the pooled vector into a score, whose temperature is fitted on rows kept out of training.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import documents, outer_id
from gradeloom.llm.word_tokens import WordHasher, release_memory, slices
from gradeloom.session import cut_lineage

BUCKETS = 2**14  # rows of the table of word vectors
DIMENSIONS = 32
NONZERO = 4  # entries of an index vector that are not 0
REACH = 2  # neighbours on each side
SAMPLE_ROWS = 20_000  # labelled rows that the network is fitted on at most
HIDDEN = 32
FEATURES = 3 * DIMENSIONS + 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(1)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1, 1], np.int64), (BUCKETS, NONZERO))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with the hashed words of their texts and the starts of the texts."""
    hasher = WordHasher(BUCKETS)
    for batch in batches:
        for begin, end in slices(batch["body"], 2_000_000):
            part = batch.slice(begin, end - begin)
            words, starts = hasher.encode(part["body"])
            yield part, words.astype(np.int64), starts
    hasher.forget()
    release_memory()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the index vectors of neighbours over all texts of the partition."""
    places, signs = index_vectors()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    for _, words, starts in _encoded(batches):
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for distance in range(1, REACH + 1):
            same = text[:-distance] == text[distance:]
            left, right = words[:-distance][same], words[distance:][same]
            for word, neighbour in ((left, right), (right, left)):
                cells = (word * DIMENSIONS)[:, None] + places[neighbour]
                sums += np.bincount(cells.ravel(), signs[neighbour].ravel(), len(sums))
    table = sums.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
    rows = np.flatnonzero(table.any(axis=1))
    columns = [pa.array(rows.astype(np.int32)), *[pa.array(table[rows, d]) for d in range(DIMENSIONS)]]
    yield pa.RecordBatch.from_arrays(columns, ["word", *[f"d{d}" for d in range(DIMENSIONS)]])


def word_vectors(rows: DataFrame) -> np.ndarray:
    """Vectors of unit length for all rows of the table, from every text."""
    dims = [f"d{d}" for d in range(DIMENSIONS)]
    partial = rows.select("body").mapInArrow(_contexts, "word int, " + ", ".join(f"{d} long" for d in dims))
    summed = partial.groupBy("word").agg(*[F.sum(d).alias(d) for d in dims]).toArrow()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMENSIONS))
    if summed.num_rows:
        table[summed["word"].to_numpy()] = np.stack([summed[d].to_numpy() for d in dims], axis=1)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(length > 0, length, 1)).astype(np.float32)


def pool(words: np.ndarray, starts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of texts: mean, spread, mean distance of neighbours, log of the length."""
    n = len(starts) - 1
    counts = np.diff(starts)
    out = np.zeros((n, FEATURES), np.float32)
    full = np.flatnonzero(counts > 0)
    if len(full):
        v = vectors[words]
        size = counts[full][:, None]
        mean = np.add.reduceat(v, starts[:-1][full], axis=0) / size
        square = np.add.reduceat(v * v, starts[:-1][full], axis=0) / size
        step = np.zeros_like(v)
        np.abs(v[1:] - v[:-1], out=step[1:])
        step[starts[:-1][full]] = 0
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[full, 2 * DIMENSIONS : -1] = np.add.reduceat(step, starts[:-1][full], axis=0) / np.maximum(size - 1, 1)
    out[:, -1] = np.log1p(counts)
    return out


def _pooled(vectors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, starts in _encoded(batches):
            found = pool(words, starts, vectors)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part["doc"], part["fp"], flat], ["doc", "fp", "pooled"])

    return run


# --- the network --------------------------------------------------------------------


@dataclass
class Network:
    """Two layers over standardised features; ``prior`` alone counts if there was nothing to learn."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return z @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3) -> Network:
    """Fit by Adam on four fifths of the rows, then the temperature on the last fifth."""
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    if len(y) < 10 or y.min() == y.max():
        return Network(prior)
    rng = np.random.default_rng(2)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = rng.permutation(len(y))
    cut = len(y) * 4 // 5
    fit_x, fit_y, rest_x, rest_y = x[order[:cut]], y[order[:cut]], x[order[cut:]], y[order[cut:]]
    net = Network(prior, fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3)
    weights = [rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    first, second, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    scaled = (fit_x - net.mean) / net.scale
    for _ in range(epochs):
        shuffled = rng.permutation(cut)
        for i in range(0, cut, batch):
            rows = shuffled[i : i + batch]
            a, target = scaled[rows], fit_y[rows]
            hidden = np.maximum(a @ weights[0] + weights[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -40, 40))) - target) / len(rows)
            back = np.outer(error, weights[2]) * (hidden > 0)
            gradients = [a.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error, np.array([error.sum()])]
            steps += 1
            for k, g in enumerate(gradients):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    logits = net.logits(rest_x)
    net.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(logits / t, rest_y)))
    return net


def _scores(network: Network) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["pooled"].flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["fp"], pa.array(network.score(x))], ["doc", "fp", "score"])

    return run


def held_out(id_: str = "doc") -> Column:
    """True where crc32 of the id as text, modulo 5, is 0 (a null id is an empty text)."""
    return F.crc32(F.coalesce(outer_id(id_).cast("string"), F.lit(""))) % 5 == 0


def drawn_labels(labels: DataFrame, id_col: str, sample_rows: int) -> DataFrame:
    """``doc, quality`` of about ``1.2 * sample_rows`` labels that are not held out, drawn by a hash of the id."""
    known = labels.select(F.col(id_col).cast("long").alias("doc"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).distinct()
    known = cut_lineage(known)
    share = min(1.0, 1.2 * sample_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc"), F.lit(2**31)) < F.lit(int(share * 2**31)))


def pooled_texts(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """Pooled vectors (``doc, fp, pooled``) of ``rows`` (``doc, body, fp``)."""
    return rows.mapInArrow(_pooled(vectors), "doc long, fp long, pooled array<float>")


def learn(pooled: DataFrame, drawn: DataFrame, sample_rows: int) -> Network:
    """Network fitted on the pooled vectors of at most ``sample_rows`` drawn labels."""
    sample = pooled.join(drawn, "doc").orderBy(F.xxhash64("doc"), "fp", "quality").limit(sample_rows)
    sample = sample.select("quality", "pooled").toArrow()
    x = sample["pooled"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return fit(x, sample["quality"].to_numpy())


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.3,
) -> DataFrame:
    """Score the quality of every text.

    Learns from ``labels`` (id and ``quality`` 0 or 1; other values and null ids are left
    out; contradicting labels of an id both count) of rows that are not held out, at most
    ``sample_rows`` of them, drawn by a hash of the id. Only the text is an
    input. Null and empty texts have the pooled vector 0 and get its score. Without labels
    of both kinds, or with fewer than ten, every score is the smoothed share of label 1.
    Repeated rows and ids are scored on their own, a null id stays null, an empty table
    gives no rows.

    Returns the id, ``held_out``, ``score`` and ``predicted`` (1 at ``threshold`` or above).
    """
    rows = documents(docs, id_col, text_col).withColumn("fp", F.xxhash64("body"))
    pooled = cut_lineage(pooled_texts(rows, word_vectors(rows)))
    network = learn(pooled, drawn_labels(labels, id_col, sample_rows), sample_rows)
    found = pooled.mapInArrow(_scores(network), "doc long, fp long, score double")
    return found.select(
        outer_id().alias(id_col),
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _good(vectors: np.ndarray, network: Network, text_col: str, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(BUCKETS)
        for batch in batches:
            body = pc.fill_null(batch[text_col], "")
            for begin, end in slices(body, 2_000_000):
                words, starts = hasher.encode(body.slice(begin, end - begin))
                good = network.score(pool(words.astype(np.int64), starts, vectors)) >= threshold
                yield batch.slice(begin, end - begin).filter(pa.array(good))
        hasher.forget()
        release_memory()

    return run


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = 0.3,
) -> DataFrame:
    """Rows of ``docs``, with all their columns, that ``classify`` predicts as 1.

    The rows are scored where they are read, so no text is shuffled; the network is fitted
    on the rows with a drawn label, no other row is pooled twice.
    """
    rows = documents(docs, id_col, text_col).withColumn("fp", F.xxhash64("body"))
    vectors = word_vectors(rows)
    drawn = drawn_labels(labels, id_col, sample_rows)
    # The draw bounds the ids that every task gets: about 1.2 * sample_rows, whatever the tables.
    chosen = rows.join(F.broadcast(drawn.select("doc")), "doc", "left_semi").select(*rows.columns)
    network = learn(pooled_texts(chosen, vectors), drawn, sample_rows)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots cannot be handed over
    text = f"c{docs.columns.index(text_col)}"
    return named.mapInArrow(_good(vectors, network, text, threshold), named.schema).toDF(*docs.columns)
