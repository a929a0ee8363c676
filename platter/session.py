"""Session settings and shared storage used by the jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Per-query pools never exceed the widest retrieval level, so ranking filters up
# to this size may be pushed below the shuffle.
WIDEST_POOL = 5000

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": str(WIDEST_POOL),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans rely on; safe to call repeatedly."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Input per shuffle partition.
BYTES_PER_PARTITION = 512 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a table; for files their size on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """Inside, shuffles start with enough partitions for the input; adaptive execution joins the small ones.

    Never goes below the configured number of shuffle partitions. Yields the number set and
    restores the setting at the end.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(configured, -(-input_bytes // BYTES_PER_PARTITION))
    before = spark.conf.get(_INITIAL, None)
    spark.conf.set(_INITIAL, str(partitions))
    try:
        yield partitions
    finally:
        if before is None:
            spark.conf.unset(_INITIAL)
        else:
            spark.conf.set(_INITIAL, before)


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is used
    only where that is unset (single-machine tests).
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="platter-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/platter/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the part of this application."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application; call it when no result of its jobs is read any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
