"""Numbering and neighbour lookups inside groups that may be very large.

A plain ``row_number()`` or ``lag()`` sends a whole group to one task. The
functions here cut large groups into *cells* along their order columns, work inside
the cells, and carry one small row per cell across (a count, or the edge row).
The cuts are quantiles of the group's own rows, so cells fit whatever the ids or times
look like; groups of ordinary size are not cut and carry nothing. Cuts are written once:
both branches of the plan agree on them even when a lost executor makes Spark compute
one of them again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import cut_lineage

# Rows of a group that one task should see.
CELL_ROWS = 1 << 20
# Cuts of a group at most: beyond CUTS * CELL_ROWS rows its cells grow.
CUTS = 1023
# Cuts are looked up in blocks of this size.
BLOCK = 32

# Rows without an order value come first, as they do in a sort.
_FIRST_CELL = -(1 << 62)


def id_cell(column: str, width: int = CELL_ROWS) -> Column:
    """Cell of an integer order column by its value alone, for ids that are dense."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def _cuts(df: DataFrame, keys: list[str], column: str, target_rows: int) -> DataFrame:
    """``_cuts`` of the groups with more than ``target_rows`` rows, a multiple of ``target_rows`` apart."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target_rows)
    hot = cut_lineage(counts)
    if hot.isEmpty():
        return hot
    steps = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    sketch = df.join(hot, keys, "left_semi").groupBy(*keys).agg(
        F.percentile_approx(column, steps, 10 * (CUTS + 1)).alias("_steps"))
    pieces = F.least(F.ceil(F.col("_n") / target_rows), F.lit(CUTS + 1))
    at = lambda i: F.floor(i * pieces / F.lit(CUTS + 1))
    chosen = F.filter("_steps", lambda x, i: at(i + 1) > at(i))
    return cut_lineage(sketch.join(hot, keys).select(*keys, F.array_distinct(chosen).alias("_cuts")))


def _place(cuts: Column, value: Column) -> Column:
    """0 for NULL, 2k + 3 for the k-th cut itself (k from 0), 2k + 2 between: grows with the value."""
    ends = F.filter(cuts, lambda c, i: (i % BLOCK == BLOCK - 1) & (c < value))
    whole = F.size(ends) * BLOCK
    rest = F.filter(F.slice(cuts, whole + 1, BLOCK), lambda c: c < value)
    below = whole + F.size(rest)
    on_cut = F.get(cuts, below) == value
    place = F.lit(2) + 2 * below + F.coalesce(on_cut, F.lit(False)).cast("int")
    return F.when(value.isNull(), 0).otherwise(place).cast("long")


def _fitted(df: DataFrame, keys: list[str], order: list[str], target_rows: int) -> DataFrame:
    """``df`` with ``_cell``, which grows along ``order`` in groups that are cut and is NULL in all others.

    Values that fill cells of their own (equal times) are cut again along the second order column.
    """
    cuts = _cuts(df.filter(_known(keys)), keys, order[0], target_rows)
    if cuts.isEmpty():
        return df.withColumn("_cell", F.lit(None).cast("long"))
    celled = df.join(cuts, keys, "left")
    place = F.when(F.col("_cuts").isNotNull(), _place(F.col("_cuts"), F.col(order[0])))
    celled = celled.withColumn("_cell", place).drop("_cuts")
    if len(order) == 1:
        return celled
    one_value = (F.col("_cell") == 0) | (F.col("_cell") % 2 == 1)
    inner = _cuts(celled.filter(one_value), [*keys, "_cell"], order[1], target_rows)
    if not inner.isEmpty():
        celled = celled.join(inner, [*keys, "_cell"], "left")
        within = F.when(F.col("_cuts").isNotNull(), _place(F.col("_cuts"), F.col(order[1]))).otherwise(0)
    else:
        within = F.lit(0)
    return celled.withColumn("_cell", F.col("_cell") * (2 * CUTS + 4) + within).select(*df.columns, "_cell")


def _with_cell(
    df: DataFrame, keys: list[str], order: list[str] | None, cell: Column | None, target_rows: int
) -> DataFrame:
    if cell is not None:
        return df.withColumn("_cell", F.coalesce(cell.cast("long"), F.lit(_FIRST_CELL)))
    if order is None:
        raise ValueError("cells need names of order columns, or an expression of their own")
    celled = _fitted(df, keys, order, target_rows)
    # Rows without a key have no neighbours: they are dealt out.
    spread = F.pmod(F.xxhash64(*order), F.lit(CUTS)).cast("long")
    return celled.withColumn("_cell", F.when(_known(keys), F.col("_cell")).otherwise(spread))


def with_ordinal(
    df: DataFrame,
    keys: list[str],
    order: str | list[Column],
    name: str = "row_index",
    *,
    cell: Column | None = None,
    target_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``order``.

    Groups with more than ``target_rows`` rows are cut at quantiles of the order column (a
    number, date or time). An expression ``cell``, which must grow along ``order``, replaces
    the cuts where the right ones are known. Rows with a NULL group key stay, without a
    position. Without keys the whole table is numbered over ranges that Spark samples.
    """
    sort = order if isinstance(order, list) else [F.col(order)]
    if not keys and cell is None:
        return number_sorted(df, sort, name)
    celled = _with_cell(df, keys, [order] if isinstance(order, str) else None, cell, target_rows)
    group = [*keys, "_cell"]
    carried = celled.filter(_known(group))
    counts = carried.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(before)).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*sort))
    position = (F.coalesce("_before", F.lit(0)) + F.col("_inside") - 1).cast("long")
    return (
        celled.withColumn("_inside", inside)
        .join(offsets, group, "left")
        .select(*df.columns, F.when(_known(keys), position).alias(name))
    )


def with_neighbour(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    name: str,
    *,
    cell: Column | None = None,
    following: bool = False,
    target_rows: int = CELL_ROWS,
) -> DataFrame:
    """Add struct ``name`` with ``columns`` of the previous (or next) row of the group.

    ``order`` must be unique inside a group; group keys must not be NULL. Large groups are
    cut as in ``with_ordinal``, along the first order column and, where one value of it
    (equal times, or none) has too many rows, along the second.
    """
    celled = _with_cell(df, keys, order, cell, target_rows)
    group = [*keys, "_cell"]
    position = F.struct(*order)
    payload = F.struct(*columns)
    shift = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    edges = celled.filter(_known(group)).groupBy(*group).agg(edge(payload, position).alias("_edge"))
    across = edges.withColumn(
        "_outside", shift("_edge").over(Window.partitionBy(*keys).orderBy("_cell"))
    ).drop("_edge")
    inside = shift(payload).over(Window.partitionBy(*group).orderBy(*order))
    return (
        celled.withColumn("_inside", inside)
        .join(across, group, "left")
        .select(*df.columns, F.coalesce("_inside", "_outside").alias(name))
    )


def number_sorted(df: DataFrame, order: list[Column], name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row of the whole table in the given order.

    Spark samples the order columns and cuts the table into ranges, whatever the values
    look like: sparse or hashed ids and one value for all rows are spread alike as long as
    all order columns together tell rows apart. The ranges are written once, so every part
    of the plan sees the same cuts; one count for each range is carried across.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("_mark", F.monotonically_increasing_id()))
    # The id holds the range above bit 33 and the place in the range below.
    marked = marked.withColumn("_range", F.shiftright("_mark", 33))
    counts = marked.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(offsets, "_range").select(*df.columns, (F.col("_before") + inside).cast("long").alias(name))


def enumerate_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Number rows 0..n-1 in the order Spark reads them.

    ``df`` must be a table read back from files, not a shuffle result: the
    partition part of the id then follows from the file splits alone.
    """
    marked = df.withColumn("_mark", F.monotonically_increasing_id())
    # The id holds the partition number above bit 33, so that is the cell.
    return with_ordinal(marked, [], "_mark", name, cell=F.shiftright("_mark", 33)).drop("_mark")
