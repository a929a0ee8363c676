"""First-per-key, ranks and exact distributed numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.session import settle


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    The rank filter is applied inside every task before the shuffle, so a hot key
    sends one row per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def latest_enrichment(review_enriched: DataFrame) -> DataFrame:
    """The last processed row per review; the model name breaks ties."""
    return first_per_key(review_enriched, ["review_id"], [F.col("processed_at").desc(), F.col("model_used")])


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered from 1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Exact 0-based position in a total order, without moving all rows into one task.

    Rows are range-partitioned and sorted, each keeps its index inside its
    partition, and the start of a partition is the sum of the sizes before it.
    Only one number per partition is summed up centrally. The sorted rows are
    checkpointed so that counts and rows agree even if a task is run again.
    """
    by = [F.col(c) for c in order]
    placed = settle(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_index", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_index"))
        .drop("_part", "_index", "_start")
    )
