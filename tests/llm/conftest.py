from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

# Names that the operators use inside.
CLASHING = "doc long, body string, fp long, key long, row string, root long, n_lines long, `with.dot` int"


@pytest.fixture
def docs_of(spark):
    """Build documents of (id, text) rows with further columns, dealt over several partitions."""

    def build(rows, partitions=5, clashing=True):
        if clashing:
            full = [(d, t, 1, "body", 2, 3, "row", 4, 5, 6) for d, t in rows]
            df = spark.createDataFrame(full, f"doc_id long, text string, {CLASHING}")
        else:
            df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.repartition(partitions)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a long text, repeated rows and ids, ties, odd characters."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = "  A line that very MANY documents hold, with \U0001f600 and é in it \t"
    passage = prose(90)
    rows = [(None, None), (None, "null id"), (1, ""), (2, " \t\n "), (3, None), (4, "x"), (5, prose(4000)), (6, "be " * 500)]
    rows += [(10 + i, prose(30) + "\n" + shared + "\n" + prose(20) + ("\n" + shared) * (i % 3)) for i in range(8)]
    rows += [(20, prose(60))] * 3 + [(21, rows[8][1]), (21, prose(40)), (22, rows[8][1].replace(" ", "  "))]
    near = prose(200).split(" ")
    for i in range(6):
        copy = list(near)
        copy[10 * i] = f"edit{i}"
        rows.append((30 + i, " ".join(copy)))
    rows += [(40 + i, prose(15) + " " + passage + " " + prose(10)) for i in range(4)]
    return rows


@pytest.fixture
def many_partitions(spark):
    """Shuffles with more partitions than rows of a hot key, not merged."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("13", "false"), strict=True):
        spark.conf.set(name, value)
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)
