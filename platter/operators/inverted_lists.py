"""Approximate cosine top-k that holds a recall target: inverted lists behind a coarse quantiser.

Centroids come from spherical k-means on a bounded sample; every row of the table is then put into the
list of its nearest centroid. How many lists a query has to read is measured, not guessed: the exact
neighbours of sampled rows say how far down the order of lists they stand, and the number of probes is
the smallest that finds the wanted share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.operators.vector_search import ROWS_AT_ONCE, as_matrix, broadcast_if_small, merge_best, query_blocks, scan_best, unit_rows, vector_topk
from platter.session import scratch_path, settle

# Rows the centroids are fitted on, about, and rows whose exact neighbours set the number of probes.
SAMPLE_ROWS = 1 << 15
CALIBRATION_ROWS = 256
# Share of the exact results to be found by the calibration rows: a little above the 0.9 that a search must reach.
TARGET = 0.95
# Short lists leave out most: on the given vectors lists of 4 rows need a third to a half of the rows read that lists
# as long as the root of the table need. Their number is bounded by what the sample can fit.
ROWS_PER_LIST = 4
MOST_LISTS = 4096
ROUNDS = 12
# Directories of a table of lists.
DIRECTORIES = 256


def list_count(vectors: int) -> int:
    return min(MOST_LISTS, max(1, vectors // ROWS_PER_LIST))


def _drawn(corpus: DataFrame, rows: int, total: int, salt: str) -> list[Row]:
    """About `rows` rows, by a hash of the id; the same ones whenever the table is the same."""
    share = F.pmod(F.xxhash64(F.lit(salt), "review_id"), F.lit(1 << 30))
    picked = corpus.filter(share < min(1.0, rows / max(total, 1)) * (1 << 30))
    return picked.select("review_id", "embedding").orderBy("review_id", F.xxhash64("embedding")).limit(2 * rows).collect()


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 42) -> np.ndarray:
    """Unit centroids by spherical k-means; a centroid that lost all its rows moves to the row that is served worst."""
    unit = unit_rows(np.asarray(sample, dtype=np.float64))
    rng = np.random.default_rng(seed)
    centroids = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)].copy()
    for _ in range(ROUNDS):
        scores = unit @ centroids.T
        nearest, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centroids)) == 0)
        sums[empty] = unit[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = unit_rows(sums)
    return centroids


def nearest_lists(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Per unit row the list with the nearest centroid; rows are scored ROWS_AT_ONCE at a time, however long a batch is."""
    parts = [(matrix[i : i + ROWS_AT_ONCE] @ centroids.T).argmax(axis=1) for i in range(0, len(matrix), ROWS_AT_ONCE)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _write_lists(corpus: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Every row in the list of its nearest centroid (column `cell`), sorted by list; a crowded directory is split over files and tasks."""
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                matrix = unit_rows(as_matrix(batch.column("embedding"), own.shape[1]))
                yield batch.append_column("cell", pa.array(nearest_lists(matrix, own)))

    schema = T.StructType([*corpus.schema.fields, T.StructField("cell", T.LongType())])
    placed = corpus.mapInArrow(place, schema).withColumn("part", (F.col("cell") % DIRECTORIES).cast("int"))
    placed.hint("rebalance", "part").sortWithinPartitions("part", "cell").write.mode("overwrite").partitionBy("part").parquet(path)


def list_order(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Per row the lists, the one with the nearest centroid first."""
    return np.argsort(-(unit_rows(vectors) @ centroids.T), axis=1, kind="stable")


def _probes(path: str, corpus: DataFrame, centroids: np.ndarray, rows: list[Row], k: int, target: float) -> int:
    """The smallest number of lists that holds the target's share of the rows' exact neighbours, themselves left out."""
    spark = corpus.sparkSession
    asked = spark.createDataFrame([(r["review_id"], [float(x) for x in r["embedding"]]) for r in rows], "query_id bigint, embedding array<double>")
    exact = vector_topk(asked, corpus, k + 1).filter("query_id <> review_id")
    bound = len(rows) * (k + 1)
    cells = spark.read.parquet(path).select("review_id", "cell")
    found = cells.join(broadcast_if_small(exact.select("query_id", "review_id"), bound), "review_id").select("query_id", "cell").collect()
    places = {r["review_id"]: order for r, order in zip(rows, list_order(np.array([r["embedding"] for r in rows], dtype=np.float64), centroids))}
    depth = np.sort([int(np.flatnonzero(places[r["query_id"]] == r["cell"])[0]) for r in found])
    return int(depth[min(len(depth) - 1, int(np.ceil(target * len(depth))) - 1)]) + 1 if len(depth) else len(centroids)


def build_lists(corpus: DataFrame, path: str, k: int, target: float = TARGET, seed: int = 42) -> None:
    """Writes lists of all rows, centroids and the number of probes for a top-k below `path`.

    `corpus` is (review_id, embedding); rows without id or vector are left out, zero vectors stand in the first list. The sample is
    SAMPLE_ROWS rows, CALIBRATION_ROWS rows are searched exactly; both are drawn by a hash of the id and grow no further with the table.
    """
    spark = corpus.sparkSession
    known = corpus.filter(F.col("embedding").isNotNull() & F.col("review_id").isNotNull()).select("review_id", "embedding")
    total = known.count()
    sample = _drawn(known, SAMPLE_ROWS, total, "centroids")
    if sample:
        centroids = fit_centroids(np.array([r["embedding"] for r in sample], dtype=np.float64), list_count(total), seed)
    else:
        centroids = np.zeros((1, 1))
    _write_lists(known, centroids, f"{path}/lists")
    rows = _drawn(known, CALIBRATION_ROWS, total, "calibration")
    probes = _probes(f"{path}/lists", known, centroids, rows, k, target) if rows else len(sample)  # 0: no rows at all
    stored = [(i, [float(x) for x in c], probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(stored, "cell bigint, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def _quantiser(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r["centroid"] for r in rows], dtype=np.float64), rows[0]["probes"]


def search_lists(queries: DataFrame, path: str, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, review_id, score, rank): the best k of each query's nearest lists, ties by review id.

    `probes` overrides the calibrated number; all lists probed is exact. Directories and row groups that no query of a pass probes are not read.
    """
    spark = queries.sparkSession
    centroids, calibrated = _quantiser(spark, path)
    if not calibrated:
        return spark.createDataFrame([], "query_id bigint, review_id bigint, score double, rank int")
    parts = []
    for rows in query_blocks(queries):
        if rows:
            cells = list_order(np.array([r["embedding"] for r in rows], dtype=np.float64), centroids)[:, : probes or calibrated].tolist()
        else:
            cells = []
        union = sorted({c for own in cells for c in own})
        near = spark.read.parquet(f"{path}/lists").filter(F.col("part").isin(sorted({c % DIRECTORIES for c in union})) & F.col("cell").isin(union))
        parts.append(scan_best(rows, near, k, None, cells))
    return merge_best(parts, k)


def rows_scored(queries: DataFrame, path: str, probes: int | None = None) -> DataFrame:
    """(query_id, rows_scored): how many rows the lists of each query hold, from the list column alone."""
    spark = queries.sparkSession
    centroids, calibrated = _quantiser(spark, path)
    sizes = np.zeros(len(centroids), np.int64)
    for r in spark.read.parquet(f"{path}/lists").groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    found = []
    for rows in query_blocks(queries):
        if rows:
            cells = list_order(np.array([r["embedding"] for r in rows], dtype=np.float64), centroids)[:, : probes or calibrated]
            found += [(r["query_id"], int(sizes[own].sum())) for r, own in zip(rows, cells)]
    return spark.createDataFrame(found, "query_id bigint, rows_scored bigint")


def recall_report(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """One row: queries, expected, found (of the exact top-k), table_rows, indexed_rows, rows_scored. Builds its lists in the scratch folder."""
    path = scratch_path(corpus.sparkSession, "inverted-lists")
    build_lists(corpus, path, k)
    asked = settle(queries)
    exact, near = settle(vector_topk(asked, corpus, k)), search_lists(asked, path, k)
    hits = near.select("query_id", "review_id").withColumn("_hit", F.lit(1))
    counted = exact.join(hits, ["query_id", "review_id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("found")
    )
    scored = rows_scored(asked, path).agg(F.coalesce(F.sum("rows_scored"), F.lit(0)).alias("rows_scored"))
    rows = corpus.agg(F.count(F.lit(1)).alias("table_rows"))
    indexed = corpus.sparkSession.read.parquet(f"{path}/lists").agg(F.count(F.lit(1)).alias("indexed_rows"))
    parts = counted.unionByName(scored, True).unionByName(rows, True).unionByName(indexed, True)
    return parts.agg(*[F.max(c).alias(c) for c in ("queries", "expected", "found", "table_rows", "indexed_rows", "rows_scored")])
