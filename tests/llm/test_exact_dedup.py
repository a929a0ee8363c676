import hashlib

import pytest

from platter.llm import exact_dedup


def brute(rows):
    out = []
    for i, text, _ in rows:
        same = [j for j, t, _ in rows if (t or "") == (text or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits_per_row", [16, 1])
def test_edges(spark, rows, edge_docs, edge_rows, monkeypatch, bits_per_row):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", bits_per_row)
    assert rows(exact_dedup.mark_copies(edge_docs)) == brute(edge_rows)


def test_full_filter_changes_nothing(spark, rows, monkeypatch):
    """With far more rows than bits every row takes the exact way."""
    monkeypatch.setattr(exact_dedup, "_bits", lambda n: 64)
    data = [(i, f"text {i % 400}", None) for i in range(1000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert rows(exact_dedup.mark_copies(docs)) == brute(data)


def test_unique_rows_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)] + [(999, "text 1")], "doc_id long, text string")
    from platter.llm.common import ready, whole_text, written
    from pyspark.sql import functions as F

    ready(spark)
    digests = written(docs.select(F.col("doc_id").alias("_id"), F.unhex(F.sha2(whole_text(), 256)).alias("_digest")), "d")
    maybe = exact_dedup.possibly_repeated(digests, exact_dedup._bits(501)).filter("_maybe")
    ids = {r["_id"] for r in maybe.collect()}
    assert {1, 999} <= ids and len(ids) < 60


def test_empty_and_dropping(spark, no_docs, edge_docs):
    assert exact_dedup.mark_copies(no_docs).count() == 0
    kept = exact_dedup.drop_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r.text for r in kept.filter("doc_id IS NOT NULL").collect()]
    assert len([t for t in texts if t and t.startswith("the cat")]) == 1


def test_dropping_goes_by_id_and_text(spark, rows):
    docs = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (None, "C"), (7, "C"), (None, "D"), (None, "D")], "doc_id long, text string")
    assert rows(exact_dedup.drop_copies(docs)) == sorted([(1, "B"), (2, "A"), (7, "C"), (None, "D"), (None, "D")], key=repr)
