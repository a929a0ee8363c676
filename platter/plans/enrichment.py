"""Incremental review enrichment: selection, responses, strict validation, fallback, append."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C
from platter.operators import batching
from platter.operators.ranking import first_per_key
from platter.plans.staging import usable_reviews
from platter.schemas import REVIEW_ENRICHED
from platter.session import scratch_path
from platter.sources import tables

# Batch sizes, response fields and accepted labels and topics.
BATCH_SIZE = 15
MAX_ATTEMPTS = 4
REQUIRED_FIELDS = ("review_id", "sentiment_label", "sentiment_score", "topic", "key_issue")
LABELS = ("positive", "negative", "neutral")
TOPICS = ("delivery", "food_quality", "price", "service", "packaging", "other")

_ITEMS = "array<map<string,string>>"


# ----------------------------------------------------------------------- selection
def unprocessed_reviews(reviews: DataFrame, enriched: DataFrame) -> DataFrame:
    """Usable reviews without any enrichment row; ids meet as strings.

    Stored ids are made distinct first, so one enriched over and over costs one row.
    """
    pending = usable_reviews(reviews).select(
        F.col("review_id").cast("string").alias("review_id"),
        C.safe_int(F.col("rating")).alias("rating"),
        F.col("comment").cast("string").alias("comment"),
    )
    return pending.join(enriched.select("review_id").distinct(), "review_id", "left_anti")


# ------------------------------------------------------------------------- parsing
def unfenced(raw: Column) -> Column:
    """The answer without surrounding Markdown fence lines."""
    text = C.trim_all(raw)
    return C.trim_all(F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*\z", ""))


def response_text(raw: Column) -> Column:
    """The JSON array inside a model answer: fences off, first '[' to last ']'; NULL when there is none."""
    return C.extract_or_null(unfenced(raw), r"(?s)\[.*\]")


def response_parse(responses: DataFrame) -> DataFrame:
    """Adds ``items``: the parsed objects, NULL when the answer is not a JSON array of objects."""
    return responses.withColumn("items", F.from_json(response_text(F.col("raw")), _ITEMS))


def response_items(parsed: DataFrame) -> DataFrame:
    """One row per returned object with its five fields."""
    keys = [c for c in parsed.columns if c not in ("raw", "items")]
    exploded = parsed.select(*keys, F.posexplode("items").alias("position", "item"))
    return exploded.select(*keys, "position", *[F.col("item")[f].alias(f) for f in REQUIRED_FIELDS])


# ---------------------------------------------------------------------- validation
def _count_where(items: Column, rule: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, lambda i: F.coalesce(rule(i), F.lit(True))))


def response_validate(
    parsed: DataFrame,
    batches: DataFrame,
    key: str = "batch_id",
    low: float = -1.0,
    high: float = 1.0,
    topics: tuple[str, ...] | None = None,
) -> DataFrame:
    """Violation counts per response; a response counts only as a whole.

    ``batches`` holds the requested ids per batch in ``review_ids``. A batch has a
    fixed small size, so the rules run inside the row. ``topics`` switches the
    strict topic rule on.
    """
    requested = batches.select(key, F.transform("review_ids", lambda i: i.cast("string")).alias("_want"))
    rows = parsed.join(requested, key)
    items = F.coalesce(F.col("items"), F.lit([]).cast(_ITEMS))
    ids = F.filter(F.transform(items, lambda i: i["review_id"]), lambda i: i.isNotNull())
    got = F.array_distinct(ids)

    def missing_field(i: Column) -> Column:
        absent = F.lit(False)
        for name in REQUIRED_FIELDS:
            absent = absent | ~F.map_contains_key(i, name)
        return absent

    def bad_score(i: Column) -> Column:
        score = i["sentiment_score"].try_cast("double")
        return score.isNull() | ~score.between(low, high)

    checks = {
        "bad_json": F.col("items").isNull().cast("int"),
        "missing_fields": _count_where(items, missing_field),
        "bad_labels": _count_where(items, lambda i: ~i["sentiment_label"].isin(*LABELS)),
        "bad_scores": _count_where(items, bad_score),
        "unexpected_ids": F.size(F.array_except(got, "_want")),
        "missing_ids": F.size(F.array_except("_want", got)),
        "duplicate_ids": F.size(ids) - F.size(got),
        "count_gap": F.size(items) - F.size("_want"),
    }
    if topics is not None:
        checks["bad_topics"] = _count_where(items, lambda i: ~i["topic"].isin(*topics))
    checked = rows.select("*", *[c.alias(name) for name, c in checks.items()])
    # One indivisible predicate: its parts are not pushed below the join, where the
    # answer would be parsed again for each of them.
    worst = F.greatest(*[F.abs(F.col(name)) for name in checks])
    return checked.withColumn("valid", worst == 0).drop("_want")


def response_scorecard(responses: DataFrame, batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """Seven named booleans per raw response and their conjunction.

    Stricter than the batch validation: the whole answer must be JSON, scores must
    be JSON numbers in [0, 1]. Repeated ids are not a rule of their own.
    """
    requested = batches.select(key, F.transform("review_ids", lambda i: i.cast("string")).alias("_want"))
    rows = (
        responses.join(requested, key)
        .withColumn("_text", unfenced(F.col("raw")))
        .withColumn("_items", F.from_json("_text", "array<map<string,variant>>"))
        .withColumn("_typed", F.from_json("_text", _ITEMS))
    )
    json_valid = F.coalesce(F.try_parse_json("_text").isNotNull(), F.lit(False))
    length = F.json_array_length("_text")
    is_array = json_valid & length.isNotNull()
    objects = F.col("_typed").isNotNull()
    ids = F.array_distinct(
        F.filter(F.transform("_typed", lambda i: i["review_id"]), lambda i: i.isNotNull())
    )

    def every(items: str, rule: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.forall(items, lambda i: F.coalesce(rule(i), F.lit(False))), F.lit(False))

    def has_fields(i: Column) -> Column:
        found = F.lit(True)
        for name in REQUIRED_FIELDS:
            found = found & F.map_contains_key(i, name)
        return found

    def number_in_range(i: Column) -> Column:
        kind = F.schema_of_variant(i["sentiment_score"])
        value = F.try_variant_get(i["sentiment_score"], "$", "double")
        return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & value.between(0.0, 1.0)

    same_ids = (F.size(F.array_except(ids, "_want")) == 0) & (F.size(F.array_except("_want", ids)) == 0)
    flags = {
        "json_valid": json_valid,
        "is_array": is_array,
        "count_match": is_array & (length == F.size("_want")),
        "required_fields_valid": is_array & objects & every("_typed", has_fields),
        "sentiment_values_valid": is_array
        & objects
        & every("_typed", lambda i: i["sentiment_label"].isin(*LABELS)),
        "sentiment_scores_valid": is_array & objects & every("_items", number_in_range),
        "review_ids_valid": is_array & objects & F.coalesce(same_ids, F.lit(False)),
    }
    overall = F.lit(True)
    for name in flags:
        overall = overall & F.col(name)
    errors = F.concat_ws("|", *[F.when(~F.col(name), F.lit(name)) for name in flags])
    keys = [c for c in responses.columns if c != "raw"]
    return (
        rows.select(
            *keys,
            F.size("_want").alias("expected_count"),
            F.when(is_array, length).otherwise(0).alias("actual_count"),
            *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()],
        )
        .withColumn("overall_valid", overall)
        .withColumn("errors", errors)
    )


def first_valid_model(validated: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch the valid response of the model highest in priority; batches without one are absent."""
    return first_per_key(validated.filter("valid"), [key], [F.col("priority")])


# ---------------------------------------------------------------- bookkeeping, stats
SUCCESS, INVALID, FAILED = "success", "invalid", "failed"


def attempt_status() -> Column:
    """Of a validated answer: success, invalid (answered, but broken), or failed (no answer)."""
    return F.when(F.col("valid"), SUCCESS).when(F.col("raw").isNull(), FAILED).otherwise(INVALID)


def attempts_made(tries: DataFrame, key: str = "batch_id") -> DataFrame:
    """The tries of every batch up to its first success, in order of model priority and attempt; later ones are not made."""
    before = Window.partitionBy(key).orderBy("priority", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("status") == SUCCESS).over(before), F.lit(False))
    return tries.withColumn("_done", done).filter(~F.col("_done")).drop("_done")


def attempts_used(tries: DataFrame, key: str = "batch_id") -> DataFrame:
    """Per batch: tries made until the first valid answer (all when none was), over all models, and the outcome.

    ``tries`` has a row per (batch, model, attempt) with the model's ``priority`` and a ``status``.
    """
    return attempts_made(tries, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts_used"),
        F.some(F.col("status") == SUCCESS).alias("success"),
        F.count_if(F.col("status") == INVALID).alias("invalid_attempts"),
        F.count_if(F.col("status") == FAILED).alias("failed_attempts"),
    )


def model_run_stats(validated: DataFrame) -> DataFrame:
    """Per model: batches ok and failed, reviews ok, total seconds, seconds per successful review."""
    reviews_ok = F.sum(F.when(F.col("valid"), F.size("items")).otherwise(0))
    return (
        validated.groupBy("model")
        .agg(
            F.count_if("valid").alias("successful_batches"),
            F.count_if(~F.col("valid")).alias("failed_batches"),
            reviews_ok.alias("reviews_successful"),
            F.sum("seconds").alias("total_seconds"),
        )
        .withColumn(
            "seconds_per_review", C.rounded_share(F.col("total_seconds"), F.col("reviews_successful"), 4)
        )
    )


def response_time_summary(responses: DataFrame) -> DataFrame:
    """One row: responses, those with a time, average, fastest and slowest."""
    return responses.agg(
        F.count(F.lit(1)).alias("responses"),
        F.count("seconds").alias("timed"),
        C.rounded_share(F.sum("seconds"), F.count("seconds"), 4).alias("avg_seconds"),
        F.min("seconds").alias("fastest_seconds"),
        F.max("seconds").alias("slowest_seconds"),
    )


def model_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two models' results for the same reviews side by side, with match flags and score distance."""
    fields = ("sentiment_label", "sentiment_score", "topic", "key_issue")

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("review_id", *[F.col(f).alias(f"{prefix}_{f}") for f in fields])

    a, b = F.col("left_sentiment_score"), F.col("right_sentiment_score")
    return side(left, "left").join(side(right, "right"), "review_id").select(
        "*",
        F.col("left_sentiment_label").eqNullSafe(F.col("right_sentiment_label")).alias("sentiment_match"),
        F.col("left_topic").eqNullSafe(F.col("right_topic")).alias("topic_match"),
        F.abs(a.try_cast("double") - b.try_cast("double")).alias("score_difference"),
    )


def model_agreement(comparison: DataFrame) -> DataFrame:
    """One row: compared reviews, matches and percentages, 0 when nothing was compared."""
    def percent(name: str) -> Column:
        return F.coalesce(C.rounded_share(F.col(name), F.col("reviews_compared"), 4, 100), F.lit(0).cast(C.NUMERIC))

    return comparison.agg(
        F.count(F.lit(1)).alias("reviews_compared"),
        F.count_if("sentiment_match").alias("sentiment_matches"),
        F.count_if("topic_match").alias("topic_matches"),
    ).select(
        "*",
        percent("sentiment_matches").alias("sentiment_agreement_percent"),
        percent("topic_matches").alias("topic_agreement_percent"),
    )


# -------------------------------------------------------------------- clean + append
def enrich_clean(items: DataFrame, model: Column, processed_at: Column) -> DataFrame:
    """Validated objects as enrichment rows: trimmed, empty issue to NULL, numeric score, stamped."""
    return items.select(
        F.col("review_id").cast("string").alias("review_id"),
        C.trim_all(F.col("sentiment_label")).alias("sentiment_label"),
        F.col("sentiment_score").try_cast("double").alias("sentiment_score"),
        C.trim_all(F.col("topic")).alias("topic"),
        F.nullif(C.trim_all(F.col("key_issue")), F.lit("")).alias("key_issue"),
        processed_at.cast("timestamp").alias("processed_at"),
        model.cast("string").alias("model_used"),
    )


def not_yet_written(rows: DataFrame, target: DataFrame) -> DataFrame:
    """The write guard: rows whose review has no stored enrichment, one per review."""
    fresh = rows.join(target.select("review_id").distinct(), "review_id", "left_anti")
    return first_per_key(fresh, ["review_id"], [F.col("processed_at").desc(), F.col("model_used")])


def enrich_coverage(usable: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: usable reviews, enriched ones, still open ones, progress in percent."""
    ids = usable.select(F.col("review_id").cast("string").alias("review_id"))
    done = enriched.select("review_id").distinct().withColumn("_done", F.lit(1))
    return (
        ids.join(done, "review_id", "left")
        .agg(F.count(F.lit(1)).alias("usable_reviews"), F.count("_done").alias("enriched_reviews"))
        .select(
            "*",
            (F.col("usable_reviews") - F.col("enriched_reviews")).alias("open_reviews"),
            C.rounded_share(F.col("enriched_reviews"), F.col("usable_reviews"), 2, 100).alias("progress_percent"),
        )
    )


# From request payloads to raw answers. A model that has a parameter `attempt` is told the number of the try.
Responder = Callable[..., list[str]]


def call_model(batches: DataFrame, name: str, model: Responder, attempts: int = MAX_ATTEMPTS, first: int = 1) -> DataFrame:
    """Ask one model per batch; (batch_id, model, raw, attempts, error).

    A model is any function from request payloads to raw answers. It is asked one request at a
    time, up to ``attempts`` times while it raises, so that a failing request costs no
    other; where all tries fail the answer is NULL and ``error`` holds the last reason. Tries are numbered from ``first``.
    """
    told = "attempt" in inspect.signature(model).parameters

    def one(payload: str) -> tuple[str | None, int, str | None]:
        error = None
        for attempt in range(first, first + attempts):
            try:
                (answer,) = model([payload], attempt=attempt) if told else model([payload])
                return answer, attempt, None
            except Exception as failure:  # noqa: BLE001 - a failed call is data here
                error = f"{type(failure).__name__}: {failure}"
        return None, first + attempts - 1, error

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [one(payload) for payload in frame["payload"]]
            raw, tries, errors = zip(*answers) if answers else ((), (), ())
            yield pd.DataFrame(
                {"batch_id": frame["batch_id"], "model": name, "raw": list(raw), "attempts": list(tries), "error": list(errors)}
            )

    schema = "batch_id string, model string, raw string, attempts int, error string"
    return batches.select("batch_id", "payload").mapInPandas(ask, schema)


ATTEMPT_SCHEMA = "run_at string, batch_id string, model string, priority int, attempt int, status string, reviews int, error string"


def ask_until_valid(
    batches: DataFrame, name: str, model: Responder, priority: int, run_at: str, log_path: str, attempts: int = MAX_ATTEMPTS
) -> tuple[DataFrame, DataFrame]:
    """Asks one model for every batch until its answer is valid, ``attempts`` times at most.

    Every round asks for the open batches once, writes the answers, then validates them, so that an invalid answer is tried again like a
    call that failed, and a retried task never sees a different answer half-way. Each try is a row of the log, written as soon as
    it is judged. Returns the accepted answers and the batches that stay open.
    """
    spark, accepted, still_open = batches.sparkSession, [], batches
    for attempt in range(1, attempts + 1):
        answers = scratch_path(spark, "answers")
        tables.replace_table(call_model(still_open, name, model, attempts=1, first=attempt), answers)
        judged = scratch_path(spark, "judged")
        checked = response_validate(response_parse(spark.read.parquet(answers)), batches)
        sizes = batches.select("batch_id", "reviews")
        tables.replace_table(checked.select("batch_id", "model", "items", "valid", "raw", "error").join(sizes, "batch_id"), judged)
        found = spark.read.parquet(judged)
        tables.append_table(
            found.select(
                F.lit(run_at).alias("run_at"), "batch_id", "model", F.lit(priority).alias("priority"), F.lit(attempt).alias("attempt"),
                attempt_status().alias("status"), F.col("reviews").cast("int").alias("reviews"), "error",
            ),
            log_path,
        )
        accepted.append(found.filter("valid").select("batch_id", "model", "items"))
        still_open = still_open.join(found.filter("valid").select("batch_id"), "batch_id", "left_anti")
        if still_open.isEmpty():
            break
    return reduce(DataFrame.unionByName, accepted), still_open


def run_log(tries: DataFrame) -> DataFrame:
    """Per run, model and attempt: what was asked, how it went, and the share of the run's reviews that are answered so far."""
    rounds = tries.groupBy("run_at", "priority", "model", "attempt").agg(
        F.count(F.lit(1)).alias("batches_asked"),
        *[F.count_if(F.col("status") == s).alias(f"batches_{s}") for s in (SUCCESS, INVALID, FAILED)],
        F.sum("reviews").alias("reviews_asked"),
        F.coalesce(F.sum(F.when(F.col("status") == SUCCESS, F.col("reviews"))), F.lit(0)).alias("reviews_answered"),
    )
    # A run has few rounds: models times attempts.
    order = Window.partitionBy("run_at").orderBy("priority", "attempt")
    asked = F.first("reviews_asked").over(order)
    so_far = F.sum("reviews_answered").over(order)
    return rounds.withColumn("progress_percent", C.rounded_share(so_far, asked, 2, 100)).drop("priority")


def request_table(pending: DataFrame, workers: int = 1) -> DataFrame:
    """The open reviews as written requests, one row per batch."""
    spark, path = pending.sparkSession, scratch_path(pending.sparkSession, "requests")
    numbered = batching.request_payloads(batching.with_batch(pending, "review_id", BATCH_SIZE, workers))
    tables.replace_table(numbered.withColumn("batch_id", F.concat_ws("/", "worker", "batch_no")), path)
    return spark.read.parquet(path)


def answer_open(reviews: DataFrame, stored: DataFrame, models: dict[str, Responder], run_at: str, log_path: str) -> DataFrame:
    """Enrichment rows of the usable reviews that ``stored`` does not hold, one per review, models in priority order.

    Of several rows of a review the one with the smallest rating, then comment digest is asked for. Nothing is written
    but requests, answers and the log of tries.
    """
    pending = unprocessed_reviews(reviews, stored).withColumn("review_id", F.col("review_id").cast("bigint"))
    pending = first_per_key(pending, ["review_id"], [F.col("rating"), F.xxhash64("comment")])
    open_batches, answered = request_table(pending), []
    for priority, (name, model) in enumerate(models.items(), 1):
        if open_batches.isEmpty():
            break
        accepted, open_batches = ask_until_valid(open_batches, name, model, priority, run_at, log_path)
        answered.append(accepted)
    if not answered:
        return reviews.sparkSession.createDataFrame([], REVIEW_ENRICHED)
    rows = enrich_clean(response_items(reduce(DataFrame.unionByName, answered)), F.col("model"), F.lit(run_at))
    return not_yet_written(rows, stored)


def run_enrichment(
    spark: SparkSession,
    reviews: DataFrame,
    target_path: str,
    models: dict[str, Responder],
    run_at: str,
    workers: int = 1,
    log_path: str | None = None,
) -> dict[str, int]:
    """One incremental run: open reviews in batches, models in priority order, all-or-nothing, append.

    Every model asks only for batches no earlier one answered validly, and asks again, up to MAX_ATTEMPTS times, where a call fails
    or the answer is invalid. ``log_path`` names a table that gets a row per try. A second run finds only the batches that failed.
    Returns the run summary.
    """
    def target() -> DataFrame:
        return spark.read.schema(REVIEW_ENRICHED).parquet(target_path)

    before = target().count()
    pending = unprocessed_reviews(reviews, target()).withColumn("review_id", F.col("review_id").cast("bigint"))
    batches = request_table(pending, workers)
    asked = batches.agg(F.count(F.lit(1)).alias("n"), F.sum("reviews").alias("r")).first()

    open_batches, log = batches, log_path or scratch_path(spark, "attempts")
    for priority, (name, model) in enumerate(models.items(), 1):
        if open_batches.isEmpty():
            break
        accepted, open_batches = ask_until_valid(open_batches, name, model, priority, run_at, log)
        rows = enrich_clean(response_items(accepted), F.col("model"), F.lit(run_at))
        tables.append_table(not_yet_written(rows, target()), target_path)

    failed = open_batches.count()
    return {
        "reviews_selected": int(asked["r"] or 0),
        "batches": int(asked["n"]),
        "batches_completed": int(asked["n"]) - failed,
        "batches_failed": failed,
        "rows_written": target().count() - before,
    }
