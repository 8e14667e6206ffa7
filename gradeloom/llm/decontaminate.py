"""Benchmark passages in documents, with DataFrame functions only.

A window is as many words of a document as a benchmark item has. Every window with enough
shingles that occur in items of its size to reach the similarity at all is looked at,
wherever the shingles stand in the item. A window gets a SimHash over its shingles,
weighted by how often they occur. Fingerprints within the radius meet in one of eight
blocks: 23 differing bits over eight blocks leave a block with at most two, and an item is
listed under all values of a block that differ in at most two bits. What meets is compared
exactly by its weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import NULL_ID, document_columns, documents, outer_id, row_key

SHINGLE = 5
BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
# Shingles of the benchmark that may be broadcast (16 bytes each); a larger one is joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs without white space) of a text."""
    trimmed = F.trim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(trimmed == "", F.expr("array()").cast("array<bigint>")).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def shingles(words: str) -> Column:
    """Hashes of the shingles of an array of word hashes; fewer words than a shingle has are one shingle."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    # Places behind the end are null, and nulls do not count in the hash.
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)])
    )


def short_shingles(words: str, width: int) -> Column:
    """The same for items of fewer words than a shingle: hashes of all runs of ``width`` words."""
    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)]))


def counted(found: str) -> Column:
    """Turn repeated shingles into different ones, so that set sizes are weighted sizes."""
    return F.transform(
        F.col(found),
        lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(F.col(found), F.lit(1), i), lambda y: y == x))),
    )


def simhash(grouped, shingle: str) -> DataFrame:
    """Fingerprint ``print`` of each group of shingle rows: the sign of 64 weighted sums."""
    sums = [
        F.sum(F.when(F.getbit(shingle, F.lit(b)) == 1, 1).otherwise(-1)).alias(f"_bit{b}") for b in range(64)
    ]
    bits = [F.when(F.col(f"_bit{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    summed = grouped.agg(*sums)
    return summed.select(*[c for c in summed.columns if not c.startswith("_bit")], total.alias("print"))


def block_values(print_: str) -> Column:
    """The blocks of a fingerprint as an array."""
    mask = 2**BLOCK_BITS - 1
    return F.array(*[F.shiftrightunsigned(print_, k * BLOCK_BITS).bitwiseAND(mask) for k in range(BLOCKS)])


def near_masks() -> Column:
    """All block values with at most BLOCK_ERRORS bits set."""
    return F.array(*[F.lit(m).cast("long") for m in range(2**BLOCK_BITS) if m.bit_count() <= BLOCK_ERRORS])


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with words: ``item, words, n_words, found`` (shingles), ``tagged``."""
    items = documents(benchmark, item_col, text_col).select(F.col("doc").alias("item"), word_hashes(F.col("body")).alias("words"))
    items = items.where(F.size("words") > 0).distinct()
    items = items.select("*", F.size("words").alias("n_words"), shingles("words").alias("found"))
    return items.select("item", "n_words", "found", counted("found").alias("tagged"))


def near_starts(at: Column, size: Column, n_words: Column) -> Column:
    """Starts of all windows that can be 0.8 similar to an item, by the places ``at`` of its shingles (sorted)."""
    width = F.least(n_words, F.lit(SHINGLE))
    item, window = n_words - width + 1, F.greatest(F.least(n_words, size) - width + 1, F.lit(1))
    # common / (item + window - common) >= 4 / 5, and each common shingle has a place of its own.
    least = F.floor((4 * (item + window) + 8) / 9).cast("int")
    last = F.greatest(size - n_words, F.lit(0))

    def held(i: Column) -> Column:
        """Starts of the windows that hold the places i to i + least - 1."""
        low, high = F.greatest(F.get(at, i + least - 1) - window + 1, F.lit(0)), F.least(F.get(at, i), last)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.expr("array()").cast("array<int>"))

    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - least), held)))
    return F.when(F.size(at) >= least, found).otherwise(F.expr("array()").cast("array<int>"))


def windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Windows with enough shingles of items of their size: ``doc, fp, n_words, start, found``."""
    widths = [r.k for r in items.select(F.least("n_words", F.lit(SHINGLE)).alias("k")).distinct().collect()]  # 5 at most
    keys = items.select("n_words", F.explode("found").alias("shingle")).distinct()
    if keys.count() <= BROADCAST_SHINGLES:
        keys = F.broadcast(keys)
    texts = rows.select("doc", F.xxhash64("body").alias("fp"), "body")
    words = texts.select("doc", "fp", word_hashes(F.col("body")).alias("words"))
    hits = texts.select("doc", "fp", F.lit(0).alias("size"), F.lit(0).alias("n_words"), F.lit(0).alias("at")).where("false")
    for k in widths:
        # Only the hash of a shingle and its place go through the join, no text and no array.
        # The outer form keeps Spark from computing the array a second time to look for empty ones.
        listed = words.select("doc", "fp", F.size("words").alias("size"), short_shingles("words", k).alias("found"))
        at = listed.select("doc", "fp", "size", F.posexplode_outer("found").alias("at", "shingle"))
        same = keys.where(F.least("n_words", F.lit(SHINGLE)) == k) if len(widths) > 1 else keys
        hits = hits.unionByName(at.join(same, "shingle").select("doc", "fp", "size", "n_words", "at"))
    found = hits.groupBy("doc", "fp", "size", "n_words").agg(F.sort_array(F.collect_set("at")).alias("at"))
    found = found.select("doc", "fp", "n_words", near_starts(F.col("at"), F.col("size"), F.col("n_words")).alias("starts"))
    found = found.where(F.size("starts") > 0)
    found = found.groupBy("doc", "fp").agg(F.collect_list(F.struct("n_words", "starts")).alias("windows"))
    # The texts of the few documents with a window, for the words of the windows.
    cut = texts.join(found.hint("shuffle_hash"), ["doc", "fp"]).distinct()
    cut = cut.select("doc", "fp", word_hashes(F.col("body")).alias("words"), "windows")
    cut = cut.select("doc", "fp", "words", F.explode("windows").alias("window"))
    cut = cut.select("doc", "fp", "words", "window.n_words", F.explode("window.starts").alias("start"))
    cut = cut.select("doc", "fp", "n_words", "start", F.expr("slice(words, start + 1, n_words)").alias("words"))
    return cut.select("doc", "fp", "n_words", "start", shingles("words").alias("found"))


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Find windows of documents that are benchmark items at a similarity of 0.8 or more.

    Words are runs without white space of the lower-cased text, shingles are five words
    (all words of an item with fewer). Similarity is the weighted Jaccard coefficient of
    the shingles of item and window, a shingle's weight is how often it occurs. A document
    shorter than the item is one window. Of a document and an item the most similar window
    counts, of equals the first.

    One row for each pair: id, item id, ``start`` (words before the window), ``n_words``,
    ``distance`` (differing bits) and ``similarity``. Null and empty texts, on either side,
    match nothing. Rows that repeat an id are one document here, null ids stay null,
    repeated items are one item, empty tables give no rows.
    """
    items = item_table(benchmark, item_col, item_text_col)
    rows = documents(docs, id_col, text_col)
    found = windows(rows, items)
    key = ["doc", "fp", "n_words", "start"]
    # The shingles travel with the sums as one value, so windows are made only once.
    prints = simhash(found.select(*key, "found", F.explode("found").alias("shingle")).groupBy(*key, "found"), "shingle")
    item_prints = simhash(
        items.select("item", "n_words", "tagged", F.explode("found").alias("shingle")).groupBy("item", "n_words", "tagged"),
        "shingle",
    ).withColumnRenamed("print", "item_print")
    listed = item_prints.select("*", F.posexplode(block_values("item_print")).alias("block", "value"))
    listed = listed.select(
        "item", "n_words", "item_print", "tagged", "block", F.explode(near_masks()).alias("mask"), "value"
    ).withColumn("value", F.col("value").bitwiseXOR(F.col("mask")))
    asked = prints.select(*key, "print", "found", F.posexplode(block_values("print")).alias("block", "value"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # A pair that meets in several blocks is taken in the first of them.
    first = [
        F.bit_count(F.get(block_values("print"), F.lit(k)).bitwiseXOR(F.get(block_values("item_print"), F.lit(k))))
        <= BLOCK_ERRORS
        for k in range(BLOCKS)
    ]
    first_block = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(first)])
    met = asked.join(listed, ["n_words", "block", "value"]).where((distance <= RADIUS) & (F.col("block") == first_block))
    common = F.size(F.array_intersect(counted("found"), "tagged"))
    sizes = met.select(
        "doc", "item", "start", "n_words", distance.cast("int").alias("distance"),
        common.alias("common"), (F.size("found") + F.size("tagged") - common).alias("either"),
    )
    close = sizes.where(F.col("common") * 5 >= F.col("either") * 4)
    order = F.struct((F.col("common") / F.col("either")).alias("similarity"), (-F.col("start")).alias("order"), "start", "n_words", "distance")
    best = close.groupBy("doc", "item").agg(F.max(order).alias("best"))
    return best.select(
        outer_id().alias(id_col),
        F.when(F.col("item") != NULL_ID, F.col("item")).alias(item_col),
        F.col("best.start").alias("start"),
        F.col("best.n_words").alias("n_words"),
        F.col("best.distance").alias("distance"),
        F.col("best.similarity").alias("similarity"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False, **names: str
) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose id is not found by ``find_passages``.

    With ``by_row`` each id and text is a document of its own: only rows whose own text holds
    an item are dropped, whatever other rows have their id or a null id.
    """
    if not by_row:
        found = find_passages(docs, benchmark, id_col, text_col, **names).select(F.col(id_col).alias("_found")).distinct()
        return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_found"]), "left_anti")
    columns = [f"c{i}" for i in range(len(docs.columns))]  # no column of the caller clashes with the keys
    keys = document_columns(columns[docs.columns.index(id_col)], columns[docs.columns.index(text_col)])
    rows = docs.toDF(*columns).select(*keys, *columns)
    rows = rows.select(row_key(), "body", *columns)
    found = find_passages(rows.select("key", "body"), benchmark, "key", "body", **names).select("key").distinct()
    return rows.join(found, "key", "left_anti").select(*columns).toDF(*docs.columns)
