"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.common import written


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; combined inside the tasks, so a hub sends a row per task."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller v."""
    nearest = _nearest(edges)
    onward = edges.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.unionByName(nearest.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node that it reaches.

    Every step replaces edges by as many or fewer; the number of rounds grows with the
    logarithm of the longest path. Edges with a null end are ignored; loops give no row.
    """
    current = written(_tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()), "edges")
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        current = written(_tidy(_small_star(_tidy(_large_star(current)))), "edges")
