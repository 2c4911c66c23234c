"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("decimal(20,0)")).alias("h")).head()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of (u, v) links but the roots.

    Large-star links each larger neighbour to the least one around a node, small-star
    the smaller ones; both only take minima, combined before the shuffle, so a node
    with very many links is no single task's list. Rounds are written to the shared
    folder and end when nothing changes. Self-links and repeated links do not matter.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(least.select("u", F.col("m").alias("v")).unionByName(kept).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
