"""Connected components of links by alternating stars.

After Kiveris and others, "Connected Components in MapReduce and Beyond" (2014): every
vertex links its larger neighbours to its smallest one, then its smaller neighbours and
itself to the smallest, until only stars are left. A vertex with very many neighbours is
aggregated before the shuffle, and its rows meet one row of the other side in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Return ``v`` and ``root``, the smallest vertex that it is connected with, for all linked vertices.

    ``links`` has ``u`` and ``v`` (longs), in any direction and any number of times.
    """
    down = F.when(F.col("u") > F.col("v"), F.col("u")).otherwise(F.col("v")).alias("u")
    up = F.when(F.col("u") > F.col("v"), F.col("v")).otherwise(F.col("u")).alias("v")
    edges = cut_lineage(links.where("u <> v").select(down, up).distinct())  # u > v
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
