"""Shared pieces of the training-data operators: table access, scratch tables, batch sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.session import scratch_path, shared_root

# Rows of one Arrow batch; with the byte limit it bounds what a Python worker holds at once.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def ready(spark: SparkSession) -> SparkSession:
    """Batch sizes and the shared checkpoint folder; safe to call repeatedly."""
    for key, value in _CONF.items():
        spark.conf.set(key, value)
    shared_root(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df` after a round trip through a Parquet table in the shared folder.

    Cuts lineage: what follows reads files that outlive executors, and every
    reader sees the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(text: str = "text"):
    """The text column, null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def plain_names(df: DataFrame) -> DataFrame:
    """The same columns under names that mapInArrow can quote: p0, p1 and so on."""
    return df.toDF(*[f"p{i}" for i in range(len(df.columns))])


def by_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A mapInArrow function from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return run


# A group that holds more than this share of all rows is hot; there are fewer than 1 / share of them.
HOT_SHARE = 1 / 1024


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows to one row per group, without sending a hot group's rows to one task.

    `size` is the column of `groups` with the group's number of rows, `total` the number
    of all rows. Fewer than 1 / HOT_SHARE groups can be hot, so these are broadcast
    and their rows stay where they are; the others are small and join by shuffle.
    """
    hot = F.col(size) > total * HOT_SHARE
    columns = [c for c in groups.columns if c != key]
    picked = groups.filter(hot).select(F.col(key).alias("_hot_key"), F.struct(*columns).alias("_group"))
    tried = rows.join(F.broadcast(picked), F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    is_hot = F.col("_group").isNotNull()
    by_broadcast = tried.filter(is_hot).select(*rows.columns, *[F.col(f"_group.{c}").alias(c) for c in columns])
    by_shuffle = tried.filter(~is_hot).select(*rows.columns).join(groups.filter(~hot), key)
    return by_broadcast.unionByName(by_shuffle)
