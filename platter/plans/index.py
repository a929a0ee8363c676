"""Embedding table: ingest checks, dedupe, normalisation, index build, upsert, coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.functions import sqlcompat as C
from platter.functions import vector as V
from platter.operators.ranking import first_per_key
from platter.session import settle
from platter.sources import tables

METRIC = "cosine"


# ------------------------------------------------------------------- ingest checks
def embedding_problems(dimension: int) -> dict[str, Column]:
    vector = F.col("embedding")
    return {
        "missing_vector": vector.isNull(),
        "wrong_dimension": F.coalesce(F.size(vector) != dimension, F.lit(False)),
        "non_finite": F.coalesce(~V.all_finite(vector), F.lit(False)),
        "zero_norm": F.coalesce(V.norm(vector) == 0, F.lit(False)),
    }


def embedding_quality(embeddings: DataFrame, dimension: int) -> DataFrame:
    """One row: how many vectors there are and how many break each rule."""
    rules = embedding_problems(dimension)
    return embeddings.agg(
        F.count(F.lit(1)).alias("vectors"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )


def split_embeddings(embeddings: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows; quarantined ones carry the names of the rules they break."""
    rules = embedding_problems(dimension)
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    marked = embeddings.withColumn("problems", broken)
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def embedding_normalize(embeddings: DataFrame) -> DataFrame:
    """Vectors of length one. Zero vectors have none and must be quarantined before."""
    return embeddings.withColumn("embedding", V.unit(F.col("embedding"))).filter(F.col("embedding").isNotNull())


def ingest_violations(batches: DataFrame, key: str = "review_id", batch: str = "batch") -> DataFrame:
    """Per batch: NULL ids, ids that occur again, NULL and blank comments; any of them aborts the batch."""
    per_id = batches.groupBy(batch, key).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(F.col("comment").isNull()).alias("_null"),
        F.count_if(F.col("comment").isNotNull() & ~C.not_blank(F.col("comment"))).alias("_blank"),
    )
    has_id = F.col(key).isNotNull()
    return (
        per_id.groupBy(batch)
        .agg(
            F.sum("_copies").alias("rows"),
            F.sum(F.when(~has_id, F.col("_copies")).otherwise(0)).alias("null_ids"),
            F.sum(F.when(has_id, F.col("_copies") - 1).otherwise(0)).alias("duplicate_ids"),
            F.sum("_null").alias("null_comments"),
            F.sum("_blank").alias("blank_comments"),
        )
        .withColumn(
            "accepted",
            (F.col("null_ids") + F.col("duplicate_ids") + F.col("null_comments") + F.col("blank_comments")) == 0,
        )
    )


# ---------------------------------------------------------------------------- index
def index_dedupe(batches: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each review id in batch order; the vector breaks ties within a batch."""
    return first_per_key(batches, ["review_id"], [*[F.col(c) for c in order], F.xxhash64("embedding")])


def build_index(
    spark: SparkSession, batches: DataFrame, order: list[str], dimension: int, path: str
) -> DataFrame:
    """Dedupe, check, normalise and write the vectors; returns the one-row build report.

    Any broken vector stops the build before something is written.
    """
    kept = index_dedupe(batches, order)
    quality = embedding_quality(kept, dimension).first()
    broken = {name: quality[name] for name in embedding_problems(dimension) if quality[name]}
    if broken:
        raise ValueError(f"broken embeddings: {broken}")
    tables.replace_table(embedding_normalize(kept).drop(*order), path)
    return index_metadata(batches, spark.read.parquet(path), dimension)


def index_metadata(batches: DataFrame, index: DataFrame, dimension: int) -> DataFrame:
    """One row: rows loaded, duplicates removed, rows kept, dimension, metric."""
    loaded = batches.agg(F.count(F.lit(1)).alias("source_reviews_loaded"))
    final = index.agg(
        F.count(F.lit(1)).alias("final_reviews"),
        F.min(F.size("embedding")).alias("smallest_dimension"),
        F.max(F.size("embedding")).alias("largest_dimension"),
    )
    both = loaded.unionByName(final, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in (*loaded.columns, *final.columns)]
    )
    return both.select(
        "source_reviews_loaded",
        (F.col("source_reviews_loaded") - F.col("final_reviews")).alias("duplicates_removed"),
        "final_reviews",
        F.lit(dimension).alias("dimension"),
        F.lit(METRIC).alias("metric"),
        ((F.col("smallest_dimension") == dimension) & (F.col("largest_dimension") == dimension)).alias(
            "dimension_ok"
        ),
    )


def index_validation(index: DataFrame, expected_rows: int, dimension: int) -> DataFrame:
    """Re-read check: row count, distinct ids, dimension and unit length as expected."""
    return index.agg(
        (F.count(F.lit(1)) == expected_rows).alias("rows_ok"),
        (F.countDistinct("review_id") == expected_rows).alias("ids_ok"),
        F.every(F.size("embedding") == dimension).alias("dimension_ok"),
        F.every(F.abs(V.norm(F.col("embedding")) - 1) < 1e-6).alias("normalized_ok"),
    )


def vector_upsert(current: DataFrame, incoming: DataFrame, version: str | list[str] = "version") -> DataFrame:
    """One row per id, the highest version wins; repeating it changes nothing.

    Rows of one id and version differ in their vectors only; the vector's digest decides.
    """
    names = [version] if isinstance(version, str) else version
    order = [*[F.col(v).desc() for v in names], F.xxhash64("embedding")]
    return first_per_key(current.unionByName(incoming), ["review_id"], order)


# Hash buckets of a new vector table. An upsert rewrites the buckets that receive ids, so a bucket should be
# small against the table and still a file worth reading.
BUCKETS = 64
MANIFEST_SCHEMA = "bucket int, path string, buckets int, mark bigint"


def publish_upsert(
    spark: SparkSession, root: str, incoming: DataFrame, version: str | list[str] = "version", buckets: int = BUCKETS, mark: int | None = None
) -> DataFrame:
    """Merges rows into the vector table below `root` and returns the table; only buckets that receive ids are rewritten.

    The table is a manifest that names one folder per hash bucket of the ids. An upsert reads the touched buckets, writes them to
    folders of their own and then a new manifest, which keeps the folders of all other buckets. It becomes current with its
    success marker, which Spark writes last: readers see the old table or the new, and a run that is killed before leaves the
    old one. A second writer with the same number fails. `buckets` counts for a new table only; `mark` is kept in the manifest.
    """
    _, entries = _current_manifest(spark, root)
    if entries:
        buckets = entries[0]["buckets"]
    bucket = F.pmod(F.xxhash64("review_id"), F.lit(buckets)).cast("int")
    placed = settle(incoming.withColumn("bucket", bucket))
    touched = {r["bucket"] for r in placed.select("bucket").distinct().collect()}
    stored = [e["path"] for e in entries if e["bucket"] in touched]
    arrived = placed.drop("bucket")
    before = spark.read.schema(arrived.schema).parquet(*stored) if stored else arrived.limit(0)
    following = max(_manifest_numbers(spark, root), default=-1) + 1
    folder = f"{root}/data/{following:010d}-{uuid.uuid4().hex}"
    if touched:
        after = vector_upsert(before, arrived, version).withColumn("bucket", bucket)
        after.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    kept_mark = mark if mark is not None else max((e["mark"] for e in entries if e["mark"] is not None), default=None)
    manifest = [(e["bucket"], e["path"], buckets, kept_mark) for e in entries if e["bucket"] not in touched]
    manifest += [(b, f"{folder}/bucket={b}", buckets, kept_mark) for b in sorted(touched)]
    spark.createDataFrame(manifest, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{root}/manifests/{following:010d}")
    return current_vectors(spark, root, arrived.schema)


def _manifest_numbers(spark: SparkSession, root: str) -> list[int]:
    """Of all manifests, the unfinished ones of killed runs among them."""
    place = f"{root}/manifests"
    return [int(n) for n in tables.names(spark, place) if n.isdigit()] if tables.exists(spark, place) else []


def _current_manifest(spark: SparkSession, root: str) -> tuple[int | None, list[Row]]:
    """Number and rows (one per bucket) of the latest complete manifest."""
    for number in sorted(_manifest_numbers(spark, root), reverse=True):
        path = f"{root}/manifests/{number:010d}"
        if tables.exists(spark, f"{path}/_SUCCESS"):
            return number, spark.read.schema(MANIFEST_SCHEMA).parquet(path).collect()
    return None, []


def published_mark(spark: SparkSession, root: str) -> int | None:
    """The mark of the current manifest; None before the first one."""
    return max((e["mark"] for e in _current_manifest(spark, root)[1] if e["mark"] is not None), default=None)


def current_vectors(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The vectors that are served: the buckets of the latest complete manifest."""
    number, entries = _current_manifest(spark, root)
    if number is None:
        raise ValueError(f"no manifest below {root}")
    paths = [e["path"] for e in entries]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def index_coverage(usable: DataFrame, index: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: usable reviews, how many are embedded and enriched, vectors without a usable review."""
    reviews = usable.select(F.col("review_id").cast("string").alias("id")).distinct().withColumn("_r", F.lit(1))
    vectors = index.select(F.col("review_id").cast("string").alias("id")).distinct().withColumn("_v", F.lit(1))
    labels = enriched.select(F.col("review_id").cast("string").alias("id")).distinct().withColumn("_l", F.lit(1))
    has = {c: F.col(c).isNotNull() for c in ("_r", "_v", "_l")}
    return (
        reviews.join(vectors, "id", "full_outer")
        .join(labels, "id", "left")
        .agg(
            F.count_if(has["_r"]).alias("usable_reviews"),
            F.count_if(has["_v"]).alias("vectors"),
            F.count_if(has["_r"] & has["_v"]).alias("embedded_reviews"),
            F.count_if(has["_r"] & has["_l"]).alias("enriched_reviews"),
            F.count_if(has["_r"] & has["_v"] & has["_l"]).alias("embedded_and_enriched"),
            F.count_if(has["_v"] & ~has["_r"]).alias("vectors_without_review"),
        )
        .select(
            "*",
            C.rounded_share(F.col("embedded_reviews"), F.col("usable_reviews"), 2, 100).alias("embedded_percent"),
            C.rounded_share(F.col("enriched_reviews"), F.col("usable_reviews"), 2, 100).alias("enriched_percent"),
        )
    )
