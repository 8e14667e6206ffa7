"""Large CSV files in parallel, also when quoted cells hold line breaks.

Whether a line begins a record depends on all quotes before it in the file. A first pass
learns for each split what it does to that state (open or closed quotes, for either state
at its start), the states are folded along each file, and a second pass puts the records
of each split together from its known start. A record that crosses splits is joined from
its pieces, at most two for each split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.session import cut_lineage
from gradeloom.sources.csv_dataset import READ_OPTIONS

# Splits that begin inside of a cell are broadcast up to this number; a row of them is a path and a number.
BROADCAST_SPLITS = 100_000

SPLIT = ["file", "start"]


def stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if one was (``inside``) or was not before it.

    Quotes count at the start of a cell only; inside, two of them are one of the text.
    """
    at = 0
    while True:
        if inside:
            while (quote := line.find('"', at)) >= 0 and line.startswith('"', quote + 1):
                at = quote + 2
            if quote < 0:
                return True
            at, inside = quote + 1, False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``closed`` and ``opened``: the state after the split's lines for either state before them."""
    ends: dict[tuple[str, int], tuple[bool, bool]] = {}
    for batch in batches:
        for file, start, line in zip(*(batch[c].to_pylist() for c in (*SPLIT, "line")), strict=True):
            closed, opened = ends.setdefault((file, start), (False, True))
            if line is not None:
                ends[file, start] = stays_open(line, closed), stays_open(line, opened)
    rows = [{"file": f, "start": s, "closed": c, "opened": o} for (f, s), (c, o) in ends.items()]
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("closed", pa.bool_()), ("opened", pa.bool_())])
    yield pa.RecordBatch.from_pylist(rows, schema)


def _begin_inside(lines: DataFrame) -> DataFrame:
    """Splits whose first line goes on with a cell. Lines without quotes change nothing and stay in the JVM."""
    quoted = F.when(F.contains("line", F.lit('"')), F.col("line")).alias("line")
    effects = lines.select(*SPLIT, quoted).mapInArrow(_effects, "file string, start long, closed boolean, opened boolean")
    along = F.sort_array(F.collect_list(F.struct("start", "closed", "opened")))
    folded = F.aggregate(
        "splits",
        F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<start:bigint,state:boolean>>").alias("after")),
        lambda acc, s: F.struct(
            F.when(acc["open"], s["opened"]).otherwise(s["closed"]).alias("open"),
            F.array_append(
                acc["after"],
                F.struct(s["start"].alias("start"), F.when(acc["open"], s["opened"]).otherwise(s["closed"]).alias("state")),
            ).alias("after"),
        ),
        lambda acc: acc["after"],
    )
    after = effects.groupBy("file").agg(along.alias("splits")).select("file", F.inline(folded))
    # The state after a split holds at the start of the next one that has lines.
    inside = F.lag("state").over(Window.partitionBy("file").orderBy("start"))
    return after.withColumn("inside", inside).filter("inside").select(*SPLIT, "inside")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split; ``piece`` is 0 for a whole one, 1 for the end of one begun before, 2 for a
    split inside of one, 3 for the beginning of one that goes on. The header of a file is left out."""
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("piece", pa.int32()), ("record", pa.string())])
    split, begun, inside, parts, header = None, False, False, [], False

    def unfinished() -> list[tuple]:
        return [(*split, 3 if begun else 2, "\n".join(parts))] if parts else []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        rows = []
        for file, start, line, opened in zip(*(batch[c].to_pylist() for c in (*SPLIT, "line", "inside")), strict=True):
            if split != (file, start):
                rows += unfinished()
                split, begun, inside, parts, header = (file, start), not opened, opened, [], start == 0
                if header:
                    line = line.removeprefix("\ufeff")
            parts.append(line)
            inside = stays_open(line, inside) if inside or '"' in line else False
            if not inside:
                record = "\n".join(parts).removesuffix("\r")
                if header and record:
                    header = False
                elif record or not begun:
                    rows.append((file, start, 0 if begun else 1, record))
                begun, parts = True, []
        yield table(rows)
    yield table(unfinished())


def read_split_dataset(spark: SparkSession, path: str, *, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """The rows of ``read_dataset``, every file read by as many tasks as it has splits.

    Lines end in a line feed, with or without a carriage return before it. Line breaks inside
    of cells stay as they are (``read_dataset`` makes them line feeds in files whose lines end in
    a carriage return and a line feed). Quotes that are not closed by the end of a file leave one
    last record. The text is read twice.
    """
    named = spark.read.options(**READ_OPTIONS).csv(path).schema.names
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.col("value").alias("line"))
    inside = cut_lineage(_begin_inside(lines))
    if inside.count() <= broadcast_splits:
        known = lines.join(F.broadcast(inside), SPLIT, "left")  # keeps the order of the lines
    else:
        marked = lines.withColumn("mark", F.monotonically_increasing_id())
        known = marked.join(inside, SPLIT, "left").repartition(*SPLIT).sortWithinPartitions(*SPLIT, "mark")
    known = known.select(*SPLIT, "line", F.coalesce("inside", F.lit(False)).alias("inside"))
    found = cut_lineage(known.mapInArrow(_records, "file string, start long, piece int, record string"))
    # A beginning opens a record, all pieces up to the next beginning belong to it.
    pieces = found.filter("piece > 0")
    along = Window.partitionBy("file").orderBy("start", "piece")
    numbered = pieces.withColumn("n", F.sum(F.when(F.col("piece") == 3, 1).otherwise(0)).over(along))
    joined = numbered.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("start", "piece", "record"))).alias("p"))
    joined = joined.select(F.array_join(F.col("p.record"), "\n").alias("record"))
    records = found.filter("piece = 0").select("record").unionByName(joined).filter("record <> ''")
    schema = ", ".join(f"c{i} string" for i in range(len(named)))
    options = {k: v for k, v in READ_OPTIONS.items() if k not in ("header", "inferSchema", "enforceSchema")}
    return records.select(F.from_csv("record", schema, options).alias("r")).select("r.*").toDF(*named).fillna("")
