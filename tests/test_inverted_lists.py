"""Inverted lists: recall on the given vectors, exactness with all lists, and odd tables."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.operators import inverted_lists, vector_search
from platter.sources import sample

CORPUS = "review_id bigint, embedding array<float>"
QUERIES = "query_id bigint, embedding array<double>"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    corpus = sample.review_embeddings(spark, f"/root/testdata/{sf}")
    asked = corpus.filter("review_id % 50 = 0").select(F.col("review_id").alias("query_id"), "embedding")
    r = inverted_lists.recall_report(asked, corpus, 10).first()
    assert r["expected"] == 10 * r["queries"] and r["indexed_rows"] == r["table_rows"]
    assert r["found"] >= 0.9 * r["expected"]
    assert r["rows_scored"] < 0.5 * r["queries"] * r["table_rows"]


def _random(spark, rows=900, dimension=12, groups=30):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((groups, dimension))
    data = [(i, (centres[i % groups] + 0.3 * rng.standard_normal(dimension)).astype(np.float32).tolist()) for i in range(rows)]
    return data, spark.createDataFrame(data, CORPUS).repartition(4)


def test_all_lists_are_exact_and_probes_follow_the_target(spark, tmp_path):
    data, corpus = _random(spark)
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in data[::37]], QUERIES)
    path = str(tmp_path / "lists")
    inverted_lists.build_lists(corpus, path, 6)
    exact = sorted(map(tuple, vector_search.vector_topk(queries, corpus, 6).collect()))
    assert sorted(map(tuple, inverted_lists.search_lists(queries, path, 6, probes=10_000).collect())) == exact
    found = inverted_lists.search_lists(queries, path, 6)
    hits = vector_search.recall(found, vector_search.vector_topk(queries, corpus, 6)).agg(F.sum("hit"), F.sum("expected")).first()
    assert hits[0] >= 0.9 * hits[1]
    cheap, dear = (inverted_lists.rows_scored(queries, path, p).agg(F.sum("rows_scored")).first()[0] for p in (None, 10_000))
    assert cheap < 0.3 * dear == 0.3 * len(data) * queries.count()
    low, high = (str(tmp_path / t) for t in ("low", "high"))
    inverted_lists.build_lists(corpus, low, 6, target=0.5)
    inverted_lists.build_lists(corpus, high, 6, target=1.0)
    assert inverted_lists._quantiser(spark, low)[1] <= inverted_lists._quantiser(spark, path)[1] <= inverted_lists._quantiser(spark, high)[1]


def test_a_third_of_equal_vectors_stays_in_one_list_and_is_found(spark, tmp_path):
    data, _ = _random(spark, 200)
    data += [(1000 + i, [1.0] * 12) for i in range(100)]
    path = str(tmp_path / "lists")
    inverted_lists.build_lists(spark.createDataFrame(data, CORPUS), path, 5)
    best = inverted_lists.search_lists(spark.createDataFrame([(1, [2.0] * 12)], QUERIES), path, 5).orderBy("rank").collect()
    assert [r["review_id"] for r in best] == [1000, 1001, 1002, 1003, 1004]


def test_odd_tables(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(1, [1.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0])]
    inverted_lists.build_lists(spark.createDataFrame(rows, CORPUS), path, 3)
    queries = spark.createDataFrame([(9, [1.0, 0.1])], QUERIES)
    found = [r["review_id"] for r in inverted_lists.search_lists(queries, path, 10, probes=99).orderBy("rank").collect()]
    assert found == [1, 4, 4, 3]
    assert inverted_lists.search_lists(queries.limit(0), path, 3).count() == 0
    empty = str(tmp_path / "b")
    inverted_lists.build_lists(spark.createDataFrame([], CORPUS), empty, 3)
    assert inverted_lists.search_lists(queries.limit(0), empty, 3).count() == 0


def test_long_batches_take_little_memory():
    """A batch of Arrow's usual length against the largest number of lists: rows x lists is never there at once."""
    rng = np.random.default_rng(2)
    rows, centroids = rng.standard_normal((10_000, 16)), rng.standard_normal((inverted_lists.MOST_LISTS, 16))
    tracemalloc.start()
    got = inverted_lists.nearest_lists(rows, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert (got[:700] == (rows[:700] @ centroids.T).argmax(axis=1)).all() and len(got) == len(rows)
    assert len(inverted_lists.nearest_lists(rows[:0], centroids)) == 0
