"""Search, thresholds, duplicate removal and selection against brute force on small pools."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from platter.operators import dedupe, vector_search
from platter.plans import retrieval
from platter.sources import tables

VECTORS = "review_id bigint, embedding array<float>"
QUERIES = "query_id bigint, embedding array<double>"


def make_corpus(spark, n=400, d=8, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, d)).astype(np.float32)
    data[5] = 0.0
    data[7] = data[6]  # a tie
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return data.astype(np.float64), spark.createDataFrame(rows + [(9999, None)], VECTORS).repartition(5)


def make_queries(spark, n=6, d=8, seed=2):
    data = np.random.default_rng(seed).standard_normal((n, d))
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], QUERIES)


def brute_topk(queries, data, k):
    norms = np.linalg.norm(data, axis=1)
    out = {}
    for q, query in enumerate(queries):
        scores = np.array([0.0 if n == 0 else v @ query / n / np.linalg.norm(query) for v, n in zip(data, norms)])
        scores = np.round(scores, 9)
        out[q] = sorted(range(len(data)), key=lambda i: (-scores[i], i))[:k]
    return out


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["review_id"])
    return got


@pytest.mark.parametrize("k", [1, 7, 400, 1000])
def test_topk_is_exact(spark, k):
    data, corpus = make_corpus(spark)
    queries, df = make_queries(spark)
    assert found(vector_search.vector_topk(df, corpus, k)) == brute_topk(queries, data, k)


def test_topk_over_several_passes_and_salted_merge(spark, monkeypatch):
    data, corpus = make_corpus(spark)
    queries, df = make_queries(spark)
    monkeypatch.setattr(vector_search, "QUERIES_PER_PASS", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        result = vector_search.vector_topk(df, corpus, 9)
        assert found(result) == brute_topk(queries, data, 9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_floor_drops_only_low_scores(spark):
    _, corpus = make_corpus(spark)
    _, df = make_queries(spark)
    everything = vector_search.vector_topk(df, corpus, 1000).filter("score >= 0.4")
    floored = vector_search.vector_topk(df, corpus, 1000, min_score=0.4)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, floored.collect()))


def test_wrong_dimension_fails(spark):
    _, df = make_queries(spark)
    corpus = spark.createDataFrame([(1, [1.0, 2.0])], VECTORS)
    with pytest.raises(Exception, match="every vector must have 8 elements"):
        vector_search.vector_topk(df, corpus, 3).collect()


def test_no_queries(spark):
    _, corpus = make_corpus(spark)
    assert vector_search.vector_topk(spark.createDataFrame([], QUERIES), corpus, 3).count() == 0


def test_cells_prune_and_full_probe_is_exact(spark, tmp_path):
    data, corpus = make_corpus(spark)
    queries, df = make_queries(spark)
    path = str(tmp_path / "cells")
    vector_search.write_cells(corpus, path, bits=4)
    assert found(vector_search.vector_topk_lsh(df, path, 5, probes=16, bits=4)) == brute_topk(queries, data, 5)
    exact = vector_search.vector_topk(df, corpus, 5)
    some = vector_search.vector_topk_lsh(df, path, 5, probes=6, bits=4)
    scored = vector_search.rows_scored(df, path, 4, probes=6).collect()
    assert all(0 < r["rows_scored"] < r["table_rows"] == len(data) for r in scored)
    hits = vector_search.recall(some, exact).agg(F.sum("hit"), F.sum("expected")).first()
    assert hits[1] == 30 and hits[0] >= 15


@pytest.mark.parametrize(
    "scores, kept", [((0.4331, 0.36, 0.3599), 2), ((0.5105, 0.4305, 0.43), 2), ((0.3598, 0.2), 0)]
)
def test_adaptive_threshold(spark, scores, kept):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "query_id bigint, review_id bigint, score double")
    assert retrieval.adaptive_threshold(df).count() == kept


# ---------------------------------------------------------------- greedy selections
def make_pool(seed, n=60, vocabulary=12):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = r.sample([f"w{j}" for j in range(vocabulary)], r.randint(1, 8))
        vector = None if r.random() < 0.1 else [r.choice([-1.0, 0.0, 1.0]) for _ in range(4)]
        rows.append((seed, i, i + 1, round(1 - i / 200 - r.choice([0, 0.01]), 9), words, r.choice("aaaabc"), vector))
    return rows


POOL = (
    "query_id bigint, review_id bigint, rank int, score double, tokens array<string>, pattern string, "
    "embedding array<double>"
)


def similar_words(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) >= 0.75


def similar_vectors(a, b, limit):
    if a is None or b is None or not any(a) or not any(b):
        return False
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9) >= limit


def slow_near(rows):
    kept, repeats = [], {}
    for row in sorted(rows, key=lambda x: (-x[3], x[1])):
        first = next((k for k in kept if similar_words(row[4], k[4])), None)
        repeats[row[1]] = None if first is None else first[1]
        if first is None:
            kept.append(row)
    return kept, repeats


def slow_diverse(rows, s):
    counts = pd.Series([x[5] for x in rows]).value_counts()
    dominant = {p for p, n in counts.items() if n / len(rows) >= s.dominant_share}
    picks = []
    for limit_patterns in (True, False):
        for row in rows:
            if len(picks) == s.final_k or row in picks:
                continue
            same = sum(p[5] == row[5] for p in picks)
            if limit_patterns and row[5] in dominant and same >= s.max_same_pattern:
                continue
            if not any(similar_words(row[4], p[4]) or similar_vectors(row[6], p[6], s.vector_duplicate) for p in picks):
                picks.append(row)
    return picks


SEEDS = range(6)


def test_near_dedupe_matches_brute_force(spark):
    pools = [make_pool(s) for s in SEEDS]
    df = spark.createDataFrame([r for p in pools for r in p], POOL)
    got = {(r["query_id"], r["review_id"]): r["duplicate_of"] for r in dedupe.near_dedupe(df).collect()}
    want = {(p[0][0], k): v for p in pools for k, v in slow_near(p)[1].items()}
    assert got == want and any(v is not None for v in want.values())


@pytest.mark.parametrize("settings", [dedupe.Selection(), dedupe.Selection(vector_duplicate=0.95, final_k=12, max_same_pattern=1)])
def test_diverse_select_matches_brute_force(spark, settings):
    pools = [make_pool(s) for s in SEEDS]
    df = spark.createDataFrame([r for p in pools for r in p], POOL)
    got = {}
    for r in dedupe.diverse_select(df, settings).orderBy("query_id", "pick").collect():
        got.setdefault(r["query_id"], []).append(r["review_id"])
    for p in pools:
        want = [x[1] for x in slow_diverse(sorted(p, key=lambda x: (-x[3], x[1])), settings)]
        assert got[p[0][0]] == want and len(want) <= settings.final_k


def test_progressive_matches_brute_force(spark):
    settings = dedupe.Selection(vector_duplicate=0.95, final_k=9, levels=(3, 10, 25, 60))
    pools = [make_pool(s) for s in SEEDS]
    df = spark.createDataFrame([r for p in pools for r in p], POOL)
    got = {r["query_id"]: r for r in dedupe.progressive_select(df, df.select("query_id").distinct(), settings).collect()}
    for p in pools:
        best, level_used = [], None
        for level in settings.levels:
            prefix = [x for x in p if x[2] <= level]
            kept = slow_near(prefix)[0]
            picks = [x[1] for x in slow_diverse(kept, settings)]
            best = picks if len(picks) > len(best) else best
            level_used = level
            if len(picks) == settings.final_k:
                break
        row = got[p[0][0]]
        assert (row["selected"], row["level"]) == (best, level_used)
        assert row["near_duplicates_removed"] == len(prefix) - len(kept)


def test_dominant_pattern_is_capped_then_relaxed(spark):
    def row(i, pattern):
        return (1, i, i, 1 - i / 10, [f"only{i}"], pattern, None)

    capped = [row(i, "food") for i in range(1, 7)] + [row(7, "price"), row(8, "service"), row(9, "other")]
    got = dedupe.diverse_select(spark.createDataFrame(capped, POOL)).orderBy("pick").collect()
    assert [r["review_id"] for r in got] == [1, 2, 7, 8, 9]
    relaxed = [row(i, "food") for i in range(1, 7)]
    got = dedupe.diverse_select(spark.createDataFrame(relaxed, POOL)).orderBy("pick").collect()
    assert [r["review_id"] for r in got] == [1, 2, 3, 4, 5]


def test_exact_dedupe_keeps_best_and_drops_empty(spark):
    rows = [(1, 1, 0.5, "Good food"), (1, 2, 0.9, "good  FOOD!"), (1, 3, 0.8, "!!!"), (1, 4, 0.9, "good food"),
            (2, 1, 0.1, "good food"), (1, 5, 0.7, None)]
    df = spark.createDataFrame(rows, "query_id bigint, review_id bigint, score double, comment string")
    got = dedupe.exact_dedupe(dedupe.with_text_features(df)).collect()
    assert sorted((r["query_id"], r["review_id"]) for r in got) == [(1, 2), (2, 1)]


def test_only_candidate_texts_are_normalised(spark, tmp_path):
    """The text rules must stay above the join that picks the candidates' reviews."""
    reviews = str(tmp_path / "reviews")
    spark.range(50).selectExpr("id AS review_id", "id % 5 AS rating", "'text' AS comment", "current_date() AS review_date").write.parquet(reviews)
    candidates = spark.createDataFrame([(1, 3, 0.5, 1)], "query_id bigint, review_id bigint, score double, rank int")
    enriched = spark.createDataFrame([], "review_id string, sentiment_label string, sentiment_score double, topic string, key_issue string, processed_at timestamp, model_used string")
    rows = retrieval.hydrate_candidates(candidates, spark.read.parquet(reviews), enriched, 1, text_features=True)
    plan = dedupe.exact_dedupe(rows)._jdf.queryExecution().optimizedPlan().toString()
    semi = plan.index("Join LeftSemi")
    assert "regexp_replace" in plan[:semi] and "regexp_replace" not in plan[semi:]


def test_near_dedupe_is_idempotent(spark):
    df = spark.createDataFrame(make_pool(3), POOL)
    kept = dedupe.near_dedupe(df).filter("duplicate_of IS NULL").select("query_id", "review_id")
    again = dedupe.near_dedupe(df.join(kept, ["query_id", "review_id"]))
    assert again.filter("duplicate_of IS NOT NULL").count() == 0 and again.count() == kept.count()


# -------------------------------------------------------------- intents, rendering
def test_intent_filters(spark):
    questions = spark.createDataFrame(
        [(1, "Which reviews have low ratings?"), (2, "high ratings and low ratings"), (3, "food and service"),
         (4, "hello"), (5, "good or bad?")],
        "query_id bigint, question string",
    )
    reviews = [("Tasty meal", 5), ("Rude staff", 1), ("Nothing", 2), ("great", None)]
    df = spark.createDataFrame(
        [(q, i, 0.5, text, rating) for q in range(1, 6) for i, (text, rating) in enumerate(reviews)],
        "query_id bigint, review_id bigint, score double, comment string, rating bigint",
    )
    intents = retrieval.query_intents(questions)
    rated = retrieval.intent_rating_filter(df, intents)

    def ids(frame, q):
        return sorted(r["review_id"] for r in frame.filter(F.col("query_id") == q).collect())

    assert ids(rated, 1) == [1, 2] and ids(rated, 2) == [1, 2]  # low wins over high
    assert ids(rated, 4) == [0, 1, 2, 3]
    hits = retrieval.intent_term_filter(dedupe.with_text_features(df), intents)
    assert ids(hits, 3) == [0, 1] and ids(hits, 4) == [0, 1, 2, 3]
    assert ids(hits, 5) == [1]  # with both signs only the negative terms count


def test_evidence_rendering(spark):
    questions = spark.createDataFrame([(1, "q"), (2, "q")], "query_id bigint, question string")
    schema = (
        "query_id bigint, pick int, review_id bigint, rating bigint, comment string, sentiment_label string, "
        "sentiment_score double, topic string, key_issue string"
    )
    rows = [(1, 2, 20, 1, " short ", None, None, "", None), (1, 1, 10, 5, "x" * 1001, "positive", 0.5, "food", "cold")]
    got = {r["query_id"]: r["evidence"] for r in retrieval.format_evidence(questions, spark.createDataFrame(rows, schema)).collect()}
    assert got[2] == retrieval.NO_EVIDENCE
    first, second = got[1].split("\n\n")
    assert first.split("\n") == [
        "Review ID: 10", "Rating: 5", "Comment: " + "x" * 1000 + "...", "Sentiment: positive", "Sentiment score: 0.5",
        "Topic: food", "Key issue: cold",
    ]
    assert second == "Review ID: 20\nRating: 1\nComment: short"


def test_hydration_drops_or_keeps_unmapped(spark):
    candidates = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], "query_id bigint, review_id bigint, score double, rank int")
    reviews = spark.createDataFrame([(2, 4, "ok", dt.date(2024, 1, 1)), (3, 1, "no", None)],
                                    "review_id bigint, rating bigint, comment string, review_date date")
    stamp = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    enriched = spark.createDataFrame(
        [("2", "positive", 0.5, "t", None, stamp[0], "a"), ("2", "negative", -0.5, "t", "k", stamp[1], "a")],
        "review_id string, sentiment_label string, sentiment_score double, topic string, key_issue string, "
        "processed_at timestamp, model_used string",
    )
    got = retrieval.hydrate_candidates(candidates, reviews, enriched, 2).collect()
    assert [(r["review_id"], r["sentiment_label"]) for r in got] == [(2, "negative")]
    left = retrieval.hydrate_left_ranked(candidates, reviews, 2).orderBy("rank").collect()
    assert [(r["rank"], r["review_id"], r["comment"]) for r in left] == [(1, 1, None), (2, 2, "ok")]


def test_evidence_validity(spark):
    df = spark.createDataFrame([(1, 1, 5, "a", 0.5), (1, 1, 5, " ", 0.4), (2, 1, 5, "a", 0.5)],
                               "query_id bigint, review_id bigint, rating bigint, comment string, score double")
    got = {r["query_id"]: r for r in retrieval.evidence_validity(df).collect()}
    assert (got[1]["duplicate_review_ids"], got[1]["empty_comments"], got[1]["valid"]) == (1, 1, False)
    assert got[2]["valid"]
    missing = retrieval.evidence_validity(df.drop("rating")).filter("query_id = 2").first()
    assert (missing["missing_columns"], missing["valid"]) == ("rating", False)


def test_lookup_joins_on_text_ids(spark):
    reviews = spark.createDataFrame([(1,), (2,), (3,)], "review_id bigint")
    ids = spark.createDataFrame([("2",), ("2",), ("9",)], "id string")
    assert [r[0] for r in tables.lookup_by_ids(reviews, "review_id", ids).collect()] == [2]
