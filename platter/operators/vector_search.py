"""Cosine top-k over an embedding table.

Exact search streams the corpus once: every task multiplies Arrow batches with
the query matrix and keeps its own best k per query, so what is shuffled is
bounded by tasks x queries x k and never by the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.operators.ranking import numbered, top_n_per_key
from platter.session import estimated_bytes

# Query vectors held by one task at a time; more queries take more passes.
QUERIES_PER_PASS = 512
# Rows of a batch that are scored at a time: rows x queries, or rows x lists, bounds what a Python worker holds.
ROWS_AT_ONCE = 512
# A ranked candidate row is three 8-byte values plus overhead.
CANDIDATE_BYTES = 64
BROADCAST_LIMIT = 64 << 20
# Tasks whose winners are merged in one group.
MERGED_TASKS = 64

SCORE_DIGITS = 9


def broadcast_if_small(df: DataFrame, max_rows: int, row_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """Broadcast hint only when the proven row bound fits; otherwise an ordinary join."""
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_LIMIT else df


def query_blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """Query vectors in blocks small enough for one task's memory."""
    vectors = queries.select("query_id", "embedding")
    first = vectors.limit(QUERIES_PER_PASS + 1).collect()
    if len(first) <= QUERIES_PER_PASS:
        yield first
        return
    # Exact positions: a block never holds more than QUERIES_PER_PASS vectors, whatever the ids.
    placed = numbered(vectors, ["query_id"], "_position")
    for start in range(0, placed.count(), QUERIES_PER_PASS):
        inside = F.col("_position").between(start, start + QUERIES_PER_PASS - 1)
        yield placed.filter(inside).select("query_id", "embedding").collect()


class _Best:
    """The k best (score, id) pairs of one query within one task."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []
        self.size, self.floor = 0, -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor
        if keep.any():
            self.scores.append(scores[keep])
            self.ids.append(ids[keep])
            self.size += int(keep.sum())
            if self.size > 2 * self.k:
                self.shrink()

    def shrink(self) -> None:
        if not self.size:
            return
        scores, ids = np.concatenate(self.scores), np.concatenate(self.ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids, self.size = [scores[order]], [ids[order]], len(order)
        if self.size == self.k:
            self.floor = self.scores[0][-1]


def as_matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dimension).any():
        raise ValueError(f"every vector must have {dimension} elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def scan_best(
    rows: list[Row], corpus: DataFrame, k: int, min_score: float | None, cells: list[list[int]] | None = None
) -> DataFrame:
    """The best k of every query within each task. With ``cells``, one list per query, a query
    scores only the rows of its own cells; the corpus then has a column ``cell``."""
    schema = "query_id bigint, review_id bigint, score double, task int"
    if not rows:
        return corpus.sparkSession.createDataFrame([], schema)
    query_ids = [r["query_id"] for r in rows]
    query_matrix = unit_rows(np.asarray([r["embedding"] for r in rows], dtype=np.float64)).T
    dimension = query_matrix.shape[0]
    floor = -np.inf if min_score is None else min_score
    asking: dict[int, list[int]] = {}
    for q, own in enumerate(cells or []):
        for cell in own:
            asking.setdefault(cell, []).append(q)

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray | slice, list[int]]]:
        """(rows, queries that score them)."""
        if cells is None:
            yield slice(None), list(range(len(query_ids)))
            return
        own = batch.column("cell").to_numpy(zero_copy_only=False)
        for cell in np.unique(own).tolist():
            if cell in asking:
                yield np.flatnonzero(own == cell), asking[cell]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in query_ids]
        task = TaskContext.get().partitionId()
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            ids = batch.column("review_id").to_numpy(zero_copy_only=False)
            unit = unit_rows(as_matrix(batch.column("embedding"), dimension))
            for members, wanted in blocks(batch):
                scores = np.round(unit[members] @ query_matrix[:, wanted], SCORE_DIGITS)
                for column, q in zip(scores.T, wanted):
                    passing = column >= floor
                    best[q].add(column[passing], ids[members][passing])
        for query_id, kept in zip(query_ids, best):
            kept.shrink()
            if kept.size:
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.full(kept.size, query_id), pa.int64()),
                        "review_id": pa.array(kept.ids[0], pa.int64()),
                        "score": pa.array(kept.scores[0], pa.float64()),
                        "task": pa.array(np.full(kept.size, task), pa.int32()),
                    }
                )

    usable = corpus.filter(F.col("embedding").isNotNull() & F.col("review_id").isNotNull())
    columns = ["review_id", "embedding"] + (["cell"] if cells is not None else [])
    return usable.select(*columns).mapInArrow(search, schema)


def _scan_tasks(df: DataFrame) -> int:
    size = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return -(-estimated_bytes(df) // size)


def merge_best(winners: list[DataFrame], k: int) -> DataFrame:
    """Global top-k from the winners of all tasks, merged as a tree.

    The winners of MERGED_TASKS tasks meet in one group, their winners with those of as many
    groups, and so on: a group never sees more than MERGED_TASKS x k rows of a query.
    The height follows the number of scan tasks, by Spark's estimate of the input's size.
    """
    order = [F.col("score").desc(), F.col("review_id")]
    found = reduce(DataFrame.unionByName, winners)
    tasks = max(_scan_tasks(w) for w in winners)
    while tasks > MERGED_TASKS:
        found = found.withColumn("task", F.floor(F.col("task") / MERGED_TASKS).cast("int"))
        found = top_n_per_key(found, ["query_id", "task"], order, k, "_rank").drop("_rank")
        tasks = -(-tasks // MERGED_TASKS)
    return top_n_per_key(found.drop("task"), ["query_id"], order, k)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, min_score: float | None = None) -> DataFrame:
    """(query_id, review_id, score, rank): exact cosine top-k, ties by review id.

    A zero vector scores 0. ``min_score`` may be given where lower scores are
    dropped later anyway.
    """
    return merge_best([scan_best(block, corpus, k, min_score) for block in query_blocks(queries)], k)


# ------------------------------------------------------------------ approximate search
def _planes(dimension: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, bits))


def _cells(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Cell number of each row: one bit per side of a random hyperplane."""
    sides = (vectors @ planes) >= 0
    return sides @ (1 << np.arange(planes.shape[1]))


# Vectors that a cell should hold, and the most directories of a table of cells.
VECTORS_PER_CELL = 4096
LEAST_BITS = 6
DIRECTORY_BITS = 8


def cell_bits(vectors: int) -> int:
    """Hyperplanes for a table of so many vectors: cells keep their size as the table grows."""
    return max(LEAST_BITS, (max(vectors, 1) // VECTORS_PER_CELL).bit_length())


def write_cells(corpus: DataFrame, path: str, bits: int, seed: int = 42) -> None:
    """The vectors as a table sorted by cell and partitioned by the cell's first bits.

    A search skips the directories of other cells, and row groups by their smallest and
    largest cell. The rebalance splits a crowded directory over several files and tasks.
    """
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            matrix = as_matrix(column, len(column[0]))
            cells = _cells(matrix, _planes(matrix.shape[1], bits, seed))
            yield batch.append_column("cell", pa.array(cells, pa.int64()))

    known = corpus.filter(F.col("embedding").isNotNull()).select("review_id", "embedding")
    schema = T.StructType(known.schema.fields + [T.StructField("cell", T.LongType())])
    placed = known.mapInArrow(place, schema).withColumn("part", _directory(bits))
    placed.hint("rebalance", "part").sortWithinPartitions("part", "cell").write.mode("overwrite").partitionBy("part").parquet(path)


def _directory(bits: int):
    return F.shiftright("cell", max(bits - DIRECTORY_BITS, 0)).cast("int")


def probe_list(vector: np.ndarray, bits: int, probes: int, seed: int) -> list[int]:
    """The cells nearest to a vector: its own, then those across the planes that it is closest to.

    Sets of planes come in the order of their summed distances, from a heap: each set is
    followed by the one with its last plane moved on and the one with the next plane added.
    """
    planes = _planes(len(vector), bits, seed)
    own = int(_cells(vector[None, :], planes)[0])
    margin = np.abs(vector @ planes)
    near = np.argsort(margin, kind="stable").tolist()
    found, heap = [own], [(float(margin[near[0]]), (0,))]
    while heap and len(found) < min(probes, 1 << bits):
        cost, flipped = heapq.heappop(heap)
        found.append(own ^ sum(1 << near[i] for i in flipped))
        last = flipped[-1]
        if last + 1 < bits:
            step = float(margin[near[last + 1]])
            heapq.heappush(heap, (cost + step, (*flipped, last + 1)))
            heapq.heappush(heap, (cost - float(margin[near[last]]) + step, (*flipped[:-1], last + 1)))
    return found


def _probes(rows: list[Row], bits: int, probes: int, seed: int) -> list[list[int]]:
    return [probe_list(np.asarray(r["embedding"], dtype=np.float64), bits, probes, seed) for r in rows]


def vector_topk_lsh(
    queries: DataFrame, path: str, k: int, bits: int, probes: int = 16, seed: int = 42
) -> DataFrame:
    """Approximate top-k: each query scores the rows of its own probed cells and no others.

    Directories and row groups that no query of a pass probes are not read. Probing all
    2^bits cells gives the exact result.
    """
    spark = queries.sparkSession
    parts = []
    for rows in query_blocks(queries):
        cells = _probes(rows, bits, probes, seed)
        union = sorted({c for own in cells for c in own})
        parts_read = sorted({c >> max(bits - DIRECTORY_BITS, 0) for c in union})
        near = spark.read.parquet(path).filter(F.col("part").isin(parts_read) & F.col("cell").isin(union))
        parts.append(scan_best(rows, near, k, None, cells))
    return merge_best(parts, k)


def rows_scored(queries: DataFrame, path: str, bits: int, probes: int = 16, seed: int = 42) -> DataFrame:
    """(query_id, table_rows, rows_scored): how much of the table each query looks at.

    The number of cells counted is bounded by queries x probes; sizes come from the cell column alone.
    """
    spark = queries.sparkSession
    sizes = spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    wanted = [
        (r["query_id"], cell)
        for rows in query_blocks(queries)
        for r, own in zip(rows, _probes(rows, bits, probes, seed))
        for cell in own
    ]
    probed = spark.createDataFrame(wanted, "query_id bigint, cell bigint")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("table_rows"))
    return (
        probed.join(sizes, "cell", "left")
        .groupBy("query_id")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_scored"))
        .crossJoin(F.broadcast(total))  # one row
        .select("query_id", "table_rows", "rows_scored")
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, hit): how many of the exact results the approximate search returned."""
    hits = found.select("query_id", "review_id", F.lit(1).alias("_hit"))
    return (
        exact.join(hits, ["query_id", "review_id"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("hit"))
    )
