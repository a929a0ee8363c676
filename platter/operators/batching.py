"""Worker shards, fixed-size batches, keyset pages and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C
from platter.operators.ranking import numbered, top_n_per_key


def with_worker(df: DataFrame, key: str, workers: int) -> DataFrame:
    """Worker number 1..workers by remainder of the id."""
    return df.withColumn("worker", (F.pmod(F.col(key), F.lit(workers)) + 1).cast("int"))


def with_batch(df: DataFrame, key: str, size: int, workers: int = 1) -> DataFrame:
    """Worker and 1-based batch number; batches hold exactly ``size`` rows but the last of a worker.

    Positions are exact over the whole table without sorting it in one task.
    """
    placed = numbered(with_worker(df, key, workers), ["worker", key], "_position")
    starts = placed.groupBy("worker").agg(F.min("_position").alias("_first"))
    return (
        placed.join(F.broadcast(starts), "worker")  # one row per worker
        .withColumn("batch_no", F.floor((F.col("_position") - F.col("_first")) / size) + 1)
        .drop("_position", "_first")
    )


def request_payloads(batched: DataFrame) -> DataFrame:
    """One row per batch: its ids in order and the JSON request of {review_id, rating, comment}."""
    item = F.struct(F.col("review_id"), F.col("rating"), F.col("comment"))
    return (
        batched.groupBy("worker", "batch_no")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "worker",
            "batch_no",
            F.size("items").alias("reviews"),
            F.transform("items", lambda i: i["review_id"]).alias("review_ids"),
            F.to_json("items").alias("payload"),
        )
    )


def first_n(df: DataFrame, n: int, as_text: bool = False, key: str = "review_id") -> DataFrame:
    """The first n rows by id; as text the order is 1, 10, 100, 11, ..."""
    order = F.col(key).cast("string") if as_text else F.col(key)
    return df.orderBy(order).limit(n)


def keyset_page(df: DataFrame, key: str, after: int | None, size: int) -> DataFrame:
    """The next ``size`` rows after a key, in key order; the range filter reaches the scan."""
    rest = df if after is None else df.filter(F.col(key) > after)
    return rest.orderBy(key).limit(size)


_PRIME = 2147483647


def sample_order(key: str, seed: int) -> Column:
    """A reproducible shuffling number from plain arithmetic: a scaled, shifted and squared id modulo a prime."""
    x = F.pmod(F.pmod(F.col(key), F.lit(_PRIME)) * F.lit(1103515245) + F.lit(seed * 12345), F.lit(_PRIME))
    return F.pmod(x * x, F.lit(_PRIME))


# Sample sizes per rating stratum.
STRATA = {"positive": 10, "negative": 10, "medium": 10, "random": 20}


def stratified_sample(reviews: DataFrame, seed: int, strata: dict[str, int] | None = None) -> DataFrame:
    """Seeded sample per rating stratum plus one over everything; strata overlap and are not deduplicated.

    Ids are drawn first: each task keeps its own first ids per stratum, so only
    narrow rows are sorted. The drawn ids then fetch their rows.
    """
    sizes = strata or STRATA
    rating = C.safe_int(F.col("rating"))
    member = {"positive": rating >= 4, "negative": rating <= 2, "medium": rating == 3, "random": F.lit(True)}
    names = F.array_compact(F.array(*[F.when(member[name], F.lit(name)) for name in sizes]))
    tagged = reviews.select("review_id", F.explode(names).alias("stratum"), sample_order("review_id", seed).alias("_order"))
    ranked = top_n_per_key(
        tagged, ["stratum"], [F.col("_order"), F.col("review_id")], max(sizes.values()), "_rank"
    )
    size = F.lit(0)
    for name, n in sizes.items():
        size = F.when(F.col("stratum") == name, F.lit(n)).otherwise(size)
    drawn = ranked.filter(F.col("_rank") <= size).select("review_id", "stratum")
    return reviews.join(F.broadcast(drawn), "review_id")  # at most the sum of the stratum sizes
