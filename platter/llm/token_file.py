"""Token ids in ORC: run-length encoded ids, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id, so every file holds one range of ids in ascending
order and its statistics prune reads by id; each file's stripes are read in parallel. A
file stores offsets from its own start; what lies before a file is the sum over the files
before it, one number a file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platter.llm.common import by_batch, ready, whole_text
from platter.llm.tokens import encoder

ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 64 << 20


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text, appends `end_id` and writes ORC files in ascending id order.

    Columns: id, part (number of the file's id range), local_start (ids before the row in its
    part), n_tokens, tokens. Null texts count as empty (only the end id). Null ids come
    first. Rows with equal ids stand together, in the order of their texts; every row is
    kept. Other columns are ignored. An empty table gives files without rows.
    """
    ready(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode_batch
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            encoded = [ids + end for ids in encode(batch.column(1).to_pylist())]
            sizes = np.array([len(ids) // 4 for ids in encoded], np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            offsets = pa.array(np.r_[0, ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(encoded), part, np.int64)),
                    pa.array(start + ends - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets, values),
                ],
                ["_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(ends[-1]) if len(ends) else 0

    placed = (
        docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
        .repartitionByRange("_id")
        .sortWithinPartitions("_id", "_text")
    )
    schema = (
        f"_id {placed.schema['_id'].dataType.simpleString()}, part long, local_start long, n_tokens long, tokens array<int>"
    )
    (
        placed.mapInArrow(run, schema)
        .withColumnRenamed("_id", id_col)
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "lz4")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with `start`, the number of ids of all documents before each.

    Filters on the id column reach the files: ranges, row indexes and Bloom filters
    leave out files, stripes and row groups. The starts of the parts come from the
    n_tokens column alone, one row a file.
    """
    rows = spark.read.orc(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    return (
        rows.join(F.broadcast(starts), "part")
        .withColumn("start", F.col("_base") + F.col("local_start"))
        .drop("_base", "local_start", "part")
    )


def token_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy()
        flat = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        sizes = np.diff(offsets).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array(crc, pa.int64())],
            ["_id", "start", "n_tokens", "ids_crc32"],
        )

    given = tokens.select(F.col(id_col).alias("_id"), "start", "tokens")
    schema = f"_id {given.schema['_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long"
    return given.mapInArrow(by_batch(run), schema).withColumnRenamed("_id", id_col)
