import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from platter.llm import perplexity as px
from platter.llm.common import ready

ORDER = px.ORDER


def grams_of(text):
    seen = []
    for c in text:
        c = " " if c.isspace() or ord(c) < 32 else "0" if c in "0123456789" else c
        if not (c == " " and seen and seen[-1] == " "):
            seen.append(c)
    padded = "\x02" * (ORDER - 1) + "".join(seen)
    return [padded[i : i + ORDER] for i in range(len(seen))]


class Brute:
    """Interpolated modified Kneser-Ney by its recursive definition."""

    def __init__(self, texts):
        counts = {ORDER: Counter(g for t in texts for g in grams_of(t))}
        for n in range(ORDER - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        self.counts = counts
        self.after = {n: defaultdict(list) for n in counts}
        for n, table in counts.items():
            for g, c in table.items():
                self.after[n][g[:-1]].append(c)
        self.d = {}
        for n, table in counts.items():
            k = Counter(table.values())
            for i in (1, 2, 3):
                d = 0.75
                if k[1] and k[2] and k[3]:
                    value = i - (i + 1) * (k[1] / (k[1] + 2 * k[2])) * k[i + 1] / k[i]
                    d = value if 0 < value < i else 0.75
                self.d[n, i] = d

    def p(self, g, n=ORDER):
        if n == 0:
            return 1 / (len(self.counts[1]) + 1)
        g = g[-n:]
        own = self.after[n].get(g[:-1])
        if own is None:
            return self.p(g, n - 1)
        c = self.counts[n].get(g, 0)
        weight = sum(self.d[n, min(x, 3)] for x in own) / sum(own)
        return (c - self.d[n, min(c, 3)] if c else 0) / sum(own) + weight * self.p(g, n - 1)

    def perplexity(self, text):
        grams = grams_of(text)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams)) if grams else None


@pytest.mark.parametrize("at_once, block", [(1 << 19, 16 << 20), (1 << 19, 2000), (7, 2000)])
def test_equals_definition(spark, monkeypatch, at_once, block):
    monkeypatch.setattr(px, "AT_ONCE", at_once)
    monkeypatch.setattr(px, "BLOCK_BYTES", block)
    ready(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500").limit(60).cache()
    rows = docs.collect()
    trusted = {r.doc_id for r in rows[::2]}
    blocks = px.pack_blocks(docs, "doc_id", "text", "lang")
    counts = px.count_trusted(blocks, spark.createDataFrame([(i,) for i in trusted], "_id long"))
    got = {r._id: r for r in px.score(blocks, px.estimate(counts)).collect()}
    assert len(got) == len(rows)
    models = {lang: Brute([r.text for r in rows if r.doc_id in trusted and r.lang == lang]) for lang in {r.lang for r in rows if r.doc_id in trusted}}
    for r in rows:
        if r.lang in models:
            assert got[r.doc_id].perplexity == pytest.approx(models[r.lang].perplexity(r.text), rel=1e-9)
            assert got[r.doc_id].n_chars == len(grams_of(r.text))
        else:
            assert got[r.doc_id].perplexity is None


def test_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = px.classify(docs, labels).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_keeps_hardly_any_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    counted = px.classify(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    counts = {(r.quality, r.kept): r["count"] for r in counted}
    assert counts.get((0, True), 0) <= 1 and counts.get((1, False), 0) <= 3, counts


def test_pieces_of_a_text_change_nothing(monkeypatch):
    texts = ["a  \t b" * 40, "", "x", " " * 30 + "y", "1234 \u00e9\U0001f600 " * 25]
    whole = px._distinct(texts)
    for at_once in (1, 2, 3, 5, 64):
        monkeypatch.setattr(px, "AT_ONCE", at_once)
        grams, counts = px._distinct(texts)
        assert grams == whole[0] and counts.tolist() == whole[1].tolist()
    assert grams == sorted(grams)
    assert Counter(dict(zip(grams, counts.tolist()))) == Counter(g for t in texts for g in grams_of(t))


def test_leaves_no_table_behind(spark, edge_docs):
    before = {t.name for t in spark.catalog.listTables()}
    px.classify(edge_docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    rows = px.classify(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        if r.doc_id in (2, 3):
            assert not r.kept and r.perplexity is None and r.n_chars == 0
        if r.doc_id == 13:
            assert r.kept and r.perplexity is None and r.lang == "xx"
    assert {r.lang for r in rows if r.doc_id == 4} == {"und"}
    assert px.classify(no_docs, labels).count() == 0
    assert all(r.kept == (r.n_chars > 0) for r in px.classify(edge_docs, labels.limit(0)).collect())


def test_texts_of_a_block_are_strings_in_turn():
    """A worker holds a block once, not also as strings: those are made for a piece at a time."""
    texts = [f"{i} " + "ab cd ef " * 2000 for i in range(400)]
    rows = pa.table({"lang": ["en", "de"] * 200, "text": texts})
    tracemalloc.start()
    try:
        seen = {lang: (at.tolist(), sum(len(t) for t in some)) for lang, at, some in px._by_language(rows)}
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == {k: (list(range(i, 400, 2)), sum(map(len, texts[i::2]))) for k, i in (("en", 0), ("de", 1))}
    assert peak < rows.nbytes / 8


def test_a_block_is_not_copied():
    """Neither the whole block nor the texts of a language stand a second time in a worker's memory."""
    rows = pa.concat_tables([pa.table({"lang": ["en", "de"] * 50, "text": ["ab cd ef " * 1000] * 100})] * 3)
    before, most = pa.total_allocated_bytes(), 0
    for _, _, texts in px._by_language(rows):
        for _ in texts:
            most = max(most, pa.total_allocated_bytes() - before)
    assert most < rows.nbytes / 8


def test_places_of_hashes():
    keys = np.unique(np.r_[np.arange(5, dtype=np.uint64), np.uint64(2**64 - 1), np.random.default_rng(7).integers(0, 2**64, 2000, np.uint64)])
    for some in (keys, keys[:1], keys[-1:]):
        assert px._Places(some).of(some[::-1]).tolist() == list(range(len(some)))[::-1]
