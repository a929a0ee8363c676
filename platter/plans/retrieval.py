"""Evidence retrieval: search, relevance, hydration, intent filters, selection, rendering, diagnostics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C
from platter.functions import text as X
from platter.operators import dedupe
from platter.operators.ranking import first_per_key
from platter.operators.vector_search import broadcast_if_small, vector_topk
from platter.session import settle

# Relevance and rendering settings.
MIN_RELEVANCE = 0.36
SCORE_WINDOW = 0.08
EVIDENCE_TEXT_LENGTH = 1000
NO_EVIDENCE = "No sufficiently relevant customer reviews were retrieved."
REVIEW_COLUMNS = (
    "review_id", "rating", "comment", "review_date", "score", "sentiment_label", "sentiment_score", "topic",
    "key_issue",
)


# ----------------------------------------------------------------------- relevance
def adaptive_threshold(
    candidates: DataFrame, min_relevance: float = MIN_RELEVANCE, window: float = SCORE_WINDOW
) -> DataFrame:
    """Candidates within ``window`` of their query's best score and above the floor.

    The threshold is kept as a column, rounded like the scores so that the limit
    itself always passes.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    limit = F.greatest(F.lit(min_relevance), F.round(best - F.lit(window), 9))
    return candidates.withColumn("threshold", limit).filter(F.col("score") >= F.col("threshold"))


# ----------------------------------------------------------------------- hydration
def _latest_for(enriched: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest enrichment of the wanted ids only; other rows are dropped before ranking."""
    rows = enriched.join(wanted, "review_id", "left_semi")
    latest = first_per_key(rows, ["review_id"], [F.col("processed_at").desc(), F.col("model_used")])
    return latest.select("review_id", "sentiment_label", "sentiment_score", "topic", "key_issue")


def hydrate_candidates(
    candidates: DataFrame, reviews: DataFrame, enriched: DataFrame, max_rows: int, text_features: bool = False
) -> DataFrame:
    """Candidates with rating, comment, date and latest enrichment; ids without a review are dropped.

    ``max_rows`` is the proven size of the candidates (queries x k): small enough
    and both big tables are only scanned, never shuffled. Each wanted review is
    fetched, and analysed if ``text_features`` is set, once for all queries.
    """
    ids = candidates.select("review_id").distinct()
    rows = reviews.select("review_id", "rating", "comment", "review_date").join(
        broadcast_if_small(ids, max_rows), "review_id", "left_semi"
    )
    if text_features:
        rows = dedupe.with_text_features(rows)
    text_ids = ids.select(F.col("review_id").cast("string").alias("review_id"))
    latest = _latest_for(enriched, broadcast_if_small(text_ids, max_rows)).withColumnRenamed("review_id", "_id")
    details = rows.join(latest, F.col("review_id").cast("string") == F.col("_id"), "left").drop("_id")
    return candidates.join(details, "review_id")


def hydrate_left_ranked(candidates: DataFrame, reviews: DataFrame, max_rows: int) -> DataFrame:
    """Every candidate by rank, with review columns where a review exists."""
    wanted = broadcast_if_small(candidates.select("review_id"), max_rows)
    found = reviews.select("review_id", "rating", "comment", "review_date").join(wanted, "review_id", "left_semi")
    joined = candidates.drop("rank").join(found, "review_id", "left")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("review_id"))
    return joined.withColumn("rank", F.row_number().over(by_score)).select(
        "query_id", "rank", "review_id", "score", "rating", "comment", "review_date"
    )


# ------------------------------------------------------------------------- intents
def query_intents(questions: DataFrame) -> DataFrame:
    """One boolean column per intent next to each question."""
    normalized = questions.withColumn("_q", X.normalize_text(F.col("question")))
    flags = X.intent_flags(F.col("_q"))
    return normalized.select(*questions.columns, *[flag.alias(f"wants_{name}") for name, flag in flags.items()])


def intent_rating_filter(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """Low-rating questions keep ratings up to 2, else high-rating ones keep 4 and more."""
    flags = intents.select("query_id", "wants_rating_low", "wants_rating_high")
    rating = F.col("rating").try_cast("double")
    keep = (
        F.when(F.col("wants_rating_low"), F.coalesce(rating <= 2, F.lit(False)))
        .when(F.col("wants_rating_high"), F.coalesce(rating >= 4, F.lit(False)))
        .otherwise(F.lit(True))
    )
    return candidates.join(flags, "query_id").filter(keep).drop("wants_rating_low", "wants_rating_high")


def intent_term_filter(candidates: DataFrame, intents: DataFrame) -> DataFrame:
    """Keeps rows whose tokens hit any requested term; questions without terms keep all rows."""
    flags = {name: F.col(f"wants_{name}") for name in X.INTENT_PHRASES}
    wanted = intents.select("query_id", X.requested_terms(flags).alias("_terms"))
    keep = (F.size("_terms") == 0) | F.arrays_overlap("tokens", "_terms")
    return candidates.join(wanted, "query_id").filter(keep).drop("_terms")


# ------------------------------------------------------------------------ pipeline
@dataclass
class Evidence:
    """The steps of one retrieval; each step is a subset of the one before."""

    relevant: DataFrame
    hydrated: DataFrame
    filtered: DataFrame
    pool: DataFrame


def evidence_steps(
    questions: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    reviews: DataFrame,
    enriched: DataFrame,
    max_queries: int,
    min_relevance: float = MIN_RELEVANCE,
    window: float = SCORE_WINDOW,
    widest: int = dedupe.LEVELS[-1],
) -> Evidence:
    """Search, relevance, hydration, intent filters and exact duplicate removal.

    ``max_queries`` bounds the number of query vectors and with it every
    candidate table.
    """
    max_rows = max_queries * widest
    ranked = vector_topk(queries, corpus, widest, min_score=min_relevance)
    # A few bounded rows per query, joined several times below: search and fetch only once.
    relevant = settle(adaptive_threshold(ranked, min_relevance, window))
    hydrated = settle(hydrate_candidates(relevant, reviews, enriched, max_rows, text_features=True))
    intents = query_intents(questions)
    filtered = intent_term_filter(intent_rating_filter(hydrated, intents), intents)
    pool = settle(with_vectors(dedupe.exact_dedupe(filtered), corpus, max_rows))
    return Evidence(relevant, hydrated, filtered, pool)


def step_counts(steps: Evidence, stages: DataFrame) -> DataFrame:
    """Per question, within the last level tried: how many candidates every step left, and its threshold.

    Questions whose filters or search left nothing have counts of zero; the threshold is
    NULL where nothing was relevant.
    """
    names = {"relevant": steps.relevant, "hydrated": steps.hydrated, "filtered": steps.filtered, "distinct": steps.pool}
    tagged = reduce(
        DataFrame.unionByName,
        [df.select("query_id", "rank", F.lit(name).alias("step")) for name, df in names.items()],
    )
    last = stages.select("query_id", "level", "stopped_early", "near_duplicates_removed", "selected")
    counts = (
        tagged.join(last.select("query_id", "level"), "query_id")
        .filter(F.col("rank") <= F.col("level"))
        .groupBy("query_id")
        .agg(*[F.count_if(F.col("step") == name).alias(f"{name}_rows") for name in names])
    )
    thresholds = steps.relevant.groupBy("query_id").agg(F.max("threshold").alias("threshold"))
    return (
        last.join(counts, "query_id", "left")
        .na.fill(0, [f"{name}_rows" for name in names])
        .join(thresholds, "query_id", "left")
        .withColumn("final_reviews", F.size("selected"))
        .select(
            "query_id",
            "level",
            "stopped_early",
            "threshold",
            F.col("relevant_rows").alias("semantic_candidates"),
            F.col("hydrated_rows").alias("evidence_rows"),
            (F.col("hydrated_rows") - F.col("filtered_rows")).alias("query_filtered"),
            (F.col("filtered_rows") - F.col("distinct_rows")).alias("exact_duplicates_removed"),
            "near_duplicates_removed",
            "final_reviews",
        )
    )


def with_vectors(pool: DataFrame, corpus: DataFrame, max_rows: int) -> DataFrame:
    """The embedding of every pooled review; NULL where there is none."""
    wanted = broadcast_if_small(pool.select("review_id").distinct(), max_rows)
    vectors = corpus.select("review_id", "embedding").join(wanted, "review_id", "left_semi")
    return pool.join(vectors, "review_id", "left")


def selected_evidence(stages: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, pick, review columns) of a progressive selection."""
    picks = stages.select("query_id", F.posexplode("selected").alias("_pos", "review_id"))
    return (
        picks.withColumn("pick", F.col("_pos") + 1)
        .drop("_pos")
        .join(pool, ["query_id", "review_id"])
        .select("query_id", "pick", *REVIEW_COLUMNS, "pattern")
    )


# ----------------------------------------------------------------------- rendering
def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.concat(F.lit(label), value.cast("string")))


def render_review(text_length: int | None = EVIDENCE_TEXT_LENGTH) -> Column:
    """One evidence block; optional lines appear only where there is a value.

    Comments over ``text_length`` characters are shortened, as the block is meant for a
    prompt; None keeps whole comments. The labels are fixed values.
    """
    comment = C.trim_all(F.coalesce("comment", F.lit("")))
    shortened = comment
    if text_length is not None:
        shortened = F.when(
            F.length(comment) > text_length, F.concat(F.substring(comment, 1, text_length), F.lit("..."))
        ).otherwise(comment)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Review ID: "), F.col("review_id").cast("string")),
        F.concat(F.lit("Rating: "), F.coalesce(F.col("rating").cast("string"), F.lit(""))),
        F.concat(F.lit("Comment: "), shortened),
        _line("Sentiment: ", F.col("sentiment_label")),
        _line("Sentiment score: ", F.col("sentiment_score")),
        _line("Topic: ", F.col("topic")),
        _line("Key issue: ", F.col("key_issue")),
    )


def format_evidence(
    questions: DataFrame, evidence: DataFrame, text_length: int | None = EVIDENCE_TEXT_LENGTH
) -> DataFrame:
    """(query_id, evidence): blocks in pick order, a fixed sentence where nothing was selected."""
    blocks = (
        evidence.withColumn("_block", render_review(text_length))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("pick", "_block"))).alias("_blocks"))
    )
    text = F.array_join(F.transform("_blocks", lambda b: b["_block"]), "\n\n")
    return questions.join(blocks, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit(NO_EVIDENCE)).alias("evidence")
    )


def format_context(evidence: DataFrame) -> DataFrame:
    """The older rendering with date and score, in score order; the labels are fixed values."""
    block = F.concat(
        F.lit("Review ID: "), F.col("review_id").cast("string"),
        F.lit("\nRating: "), F.coalesce(F.col("rating").cast("string"), F.lit("None")),
        F.lit(" stars\nReview: "), F.coalesce("comment", F.lit("None")),
        F.lit("\nReview date: "), F.coalesce(F.col("review_date").cast("string"), F.lit("None")),
        F.lit("\nSimilarity score: "), F.format_string("%.4f", F.col("score")),
        F.lit("\n---\n"),
    )
    return (
        evidence.withColumn("_block", block)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "_block"))).alias("_blocks"))
        .select("query_id", F.array_join(F.transform("_blocks", lambda b: b["_block"]), "").alias("context"))
    )


# --------------------------------------------------------------------- diagnostics
def retrieval_diagnostics(hydrated: DataFrame) -> DataFrame:
    """Per query: result count, score range, mapped and distinct comments, strength of the best hit."""
    comment = C.trim_all(F.coalesce("comment", F.lit("")))
    mapped = F.when(comment != "", F.sha2(comment, 256))
    return (
        hydrated.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            F.avg("score").alias("_avg"),
            F.count(mapped).alias("mapped_count"),
            F.countDistinct(mapped).alias("unique_comments"),
        )
        .withColumn("avg_score", F.round("_avg", 6))
        .withColumn(
            "strength",
            F.when(F.col("max_score") < 0.40, "weak").when(F.col("max_score") < 0.50, "below 0.50").otherwise("strong"),
        )
        .drop("_avg")
    )


def evidence_validity(evidence: DataFrame) -> DataFrame:
    """Per query: number of reviews, repeated ids, empty comments; valid when no id repeats.

    Missing columns make the result invalid for every query.
    """
    missing = [c for c in ("review_id", "rating", "comment", "score") if c not in evidence.columns]
    present = evidence if not missing else evidence.select("*", *[F.lit(None).alias(c) for c in missing])
    return (
        present.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.count("review_id").alias("_ids"),
            F.countDistinct("review_id").alias("_distinct"),
            F.count_if(~F.coalesce(C.not_blank(F.col("comment").cast("string")), F.lit(False))).alias("empty_comments"),
        )
        .select(
            "query_id",
            "review_count",
            F.lit(",".join(sorted(missing))).alias("missing_columns"),
            (F.col("_ids") - F.col("_distinct")).alias("duplicate_review_ids"),
            "empty_comments",
            (F.lit(not missing) & (F.col("_ids") == F.col("_distinct"))).alias("valid"),
        )
    )


def duplicate_comment_stats(reviews: DataFrame) -> DataFrame:
    """One row: non-NULL comments, distinct ones, repeats; texts are compared by digest."""
    comment = C.trim_all(F.col("comment"))
    return (
        reviews.filter(F.col("comment").isNotNull())
        .agg(F.count(F.lit(1)).alias("total_comments"), F.countDistinct(F.sha2(comment, 256)).alias("unique_comments"))
        .withColumn("duplicate_comments", F.col("total_comments") - F.col("unique_comments"))
    )


def pattern_distribution(reviews: DataFrame, dominant_share: float = dedupe.DOMINANT_SHARE) -> DataFrame:
    """(pattern, reviews, share, dominant) over all reviews; at most one row per family combination."""
    counts = dedupe.with_text_features(reviews).groupBy("pattern").agg(F.count(F.lit(1)).alias("reviews"))
    total = F.sum("reviews").over(Window.partitionBy())
    return counts.select(
        "pattern",
        "reviews",
        C.rounded_share(F.col("reviews"), total, 4).alias("share"),
        (F.col("reviews") / total >= dominant_share).alias("dominant"),
    )
