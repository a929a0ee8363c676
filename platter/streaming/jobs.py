"""Resumable embedding and vector ingest as Structured Streaming jobs.

The file source's checkpoint is the progress record: finished files are never
read again, an interrupted run resumes after the last committed batch, and the
Parquet sink commits each batch exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.functions import sqlcompat as C
from platter.operators.ranking import first_per_key
from platter.plans.enrichment import Responder, answer_open
from platter.plans.index import current_vectors, ingest_violations, publish_upsert, published_mark
from platter.schemas import REVIEW_ENRICHED
from platter.sources import tables

Embedder = Callable[[list[str]], np.ndarray]

IDENTITY_SCHEMA = "collection string, model string, dimension int"


def embed_rows(df: DataFrame, embed: Embedder, dimension: int, batch_rows: int = 256) -> DataFrame:
    """Adds ``embedding`` by a caller's function from texts to vectors.

    The function sees at most ``batch_rows`` texts at a time; a different number
    or size of vectors fails the task.
    """
    columns = [f for f in df.schema.fields]
    schema = T.StructType(columns + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_rows):
                part = frame.iloc[start : start + batch_rows].copy()
                vectors = np.asarray(embed(list(part["comment"])), dtype=np.float32)
                if vectors.shape != (len(part), dimension):
                    raise ValueError(f"expected {(len(part), dimension)} vector values, got {vectors.shape}")
                if not np.isfinite(vectors).all():
                    raise ValueError("the model returned a value that is not finite")
                part["embedding"] = list(vectors)
                yield part

    return df.mapInPandas(run, schema)


def _drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _files(
    spark: SparkSession, source: str, schema: T.StructType, files_per_batch: int | None, bytes_per_batch: int | None = None
) -> DataFrame:
    """Files of a source; a micro-batch takes so many of them, or as many as have that size together and one at least."""
    reader = spark.readStream.schema(schema)
    if files_per_batch and bytes_per_batch:
        raise ValueError("a micro-batch is bounded by files or by bytes, not by both")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(source)


def stream_embed(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    embed: Embedder,
    dimension: int,
    files_per_batch: int | None = None,
) -> None:
    """Embed every review file that arrived since the last run; blank comments are skipped."""
    reviews = _files(spark, source, schema, files_per_batch).filter(C.not_blank(F.col("comment")))
    _drain(embed_rows(reviews, embed, dimension), out, checkpoint)


# --------------------------------------------------------------------- enrichment
def stream_enrich(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    root: str,
    models: dict[str, Responder],
    run_at: str,
    stored: DataFrame | None = None,
    shard: int = 0,
    shards: int = 1,
    files_per_batch: int | None = None,
) -> None:
    """Enrich every review file that arrived since the shard's last run.

    Several shards may run at once: a review belongs to the shard that its id's hash names, each shard has a checkpoint of its
    own, and no two write the same review. A micro-batch asks only for reviews without a row in ``stored`` and in the shard's earlier
    micro-batches, validates, and writes the rows to the folder of its number. A run that is killed after that write repeats the
    micro-batch and replaces the folder, so no row is there twice. Reviews that no model answers validly are not stored and
    not asked again unless they arrive again. A root keeps its number of shards.
    """
    place, own = f"{root}/enriched", f"shard={shard}-of-{shards}"
    found = tables.names(spark, place) if tables.exists(spark, place) else []
    if any(not n.endswith(f"-of-{shards}") for n in found if n.startswith("shard=")):
        raise ValueError(f"{root} was written by another number of shards than {shards}: {sorted(found)}")

    def take(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        folder = f"{place}/{own}"
        epochs = tables.names(session, folder) if tables.exists(session, folder) else []
        earlier = [f"{folder}/{e}" for e in epochs if e.startswith("epoch=") and e != f"epoch={number}"]
        done = session.read.schema(REVIEW_ENRICHED).parquet(*earlier) if earlier else session.createDataFrame([], REVIEW_ENRICHED)
        known = done.select("review_id")
        if stored is not None:
            known = known.unionByName(stored.select(F.col("review_id").cast("string").alias("review_id")))
        mine = rows.filter(F.pmod(F.xxhash64(F.col("review_id").cast("string")), F.lit(shards)) == shard)
        # Enrichment reads its reviews more than once; the micro-batch is kept for that time only.
        mine = mine.select("review_id", "rating", "comment").persist()
        try:
            enriched = answer_open(mine, known.withColumn("processed_at", F.lit(None).cast("timestamp")), models, run_at, f"{root}/attempts/{own}")
            tables.replace_table(enriched, f"{folder}/epoch={number}")
        finally:
            mine.unpersist()

    query = (
        _files(spark, source, schema, files_per_batch)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint/{own}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stream_enriched(spark: SparkSession, root: str) -> DataFrame:
    """All rows that the shards have stored."""
    place = f"{root}/enriched"
    shards = [f"{place}/{n}" for n in tables.names(spark, place)] if tables.exists(spark, place) else []
    folders = [f"{s}/{e}" for s in shards for e in tables.names(spark, s) if tables.exists(spark, f"{s}/{e}/_SUCCESS")]
    return spark.read.schema(REVIEW_ENRICHED).parquet(*folders) if folders else spark.createDataFrame([], REVIEW_ENRICHED)


# ------------------------------------------------------------------------- ingest
def check_identity(spark: SparkSession, path: str, collection: str, model: str, dimension: int) -> None:
    """Refuse to mix vectors of different collections, models or dimensions; the first run records them."""
    given = (collection, model, dimension)
    if not tables.exists(spark, path):
        spark.createDataFrame([given], IDENTITY_SCHEMA).coalesce(1).write.parquet(path)
        return
    stored = tuple(spark.read.schema(IDENTITY_SCHEMA).parquet(path).first())
    if stored != given:
        raise ValueError(f"progress belongs to {stored}, this run is {given}")


def completed_batches(spark: SparkSession, out: str) -> DataFrame:
    if not tables.exists(spark, out):
        return spark.createDataFrame([], "batch bigint")
    return spark.read.parquet(out).select("batch").distinct()


def ingest_plan(batches: DataFrame, completed: DataFrame) -> DataFrame:
    """Dry run: (batch, rows, completed) of every discovered batch."""
    found = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    done = completed.select("batch").distinct().withColumn("_done", F.lit(True))
    return found.join(done, "batch", "left").select(
        "batch", "rows", F.coalesce("_done", F.lit(False)).alias("completed")
    )


def stream_ingest(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    root: str,
    embed: Embedder,
    dimension: int,
    collection: str,
    model: str,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Ingest new batch files as vector points; returns the current point table.

    The arrivals of a run are merged into a bucketed table (`compact_points`) when its files are done, so that a
    run reads the points of its own arrivals and the buckets they touch, not every arrival there has been.

    Every file that arrived since the last run is checked in the micro-batch that takes it, also
    a late file of a batch that is stored already: a violation stops the run and nothing of
    that micro-batch is written. The refused files come again in the next run. Points are
    versioned by batch and then by micro-batch, so ingesting an id again replaces its vector.
    Writing a micro-batch again replaces its own files. Finished files are not read again.
    """
    check_identity(spark, f"{root}/identity", collection, model, dimension)

    problems: list[ValueError] = []

    def take(rows: DataFrame, number: int) -> None:
        refused = ingest_violations(rows).filter(~F.col("accepted")).orderBy("batch").first()
        if refused is not None:
            problems.append(ValueError(f"batch refused: {refused.asDict()}"))
            raise problems[0]
        points = embed_rows(rows.select("batch", "review_id", "comment"), embed, dimension).drop("comment")
        tables.replace_table(points, f"{root}/points/arrival={number}")

    query = (
        _files(spark, source, schema, files_per_batch, bytes_per_batch)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if problems:
            raise problems[0] from None
        raise
    return compact_points(spark, root).drop("arrival")


def compact_points(spark: SparkSession, root: str) -> DataFrame:
    """Merges the arrivals that came after the last merge into the table of current points and returns it.

    The manifest of the table carries the last arrival merged. A merge that is killed before its manifest is complete leaves
    table and mark as they were, and the next one takes the same arrivals again; merging an arrival twice changes nothing.
    """
    place = f"{root}/points"
    arrivals = sorted(int(n.removeprefix("arrival=")) for n in tables.names(spark, place) if n.startswith("arrival=")) if tables.exists(spark, place) else []
    merged = published_mark(spark, f"{root}/current")
    fresh = [a for a in arrivals if merged is None or a > merged]
    if fresh:
        points = spark.read.parquet(place).filter(F.col("arrival").isin(fresh))
        publish_upsert(spark, f"{root}/current", current_points(points), ["batch", "arrival"], mark=fresh[-1])
    return current_vectors(spark, f"{root}/current")


def current_points(points: DataFrame) -> DataFrame:
    """One vector per review id: of its highest batch, in that of the latest arrival; the vector breaks ties."""
    return first_per_key(points, ["review_id"], [F.col("batch").desc(), F.col("arrival").desc(), F.xxhash64("embedding")])
