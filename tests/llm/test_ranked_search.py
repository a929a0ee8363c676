"""Dual-tree search against scores computed for every pair, by the definition."""

import math
import re

import numpy as np
import pytest

from platter.llm import ranked_search
from platter.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k):
    counted = [(i, words(t)) for i, t in docs if words(t)]
    n_docs, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, own in counted:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in dict.fromkeys(items):
        wanted, scored = set(words(text)), []
        for doc, own in counted:
            m = 100 - 50 + 50 * len(own) * n_docs // total
            score = 0
            for t in wanted:
                if t in own:
                    tf = own.count(t)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def frames(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("per_pass,cells", [(1024, 1 << 21), (7, 3000)])
def test_random(spark, rows, monkeypatch, per_pass, cells):
    monkeypatch.setattr(ranked_search, "ITEMS_PER_PASS", per_pass)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    rng = np.random.default_rng(5)
    make = lambda size: " ".join(f"W{int(x)}é" for x in rng.zipf(1.3, size) if x < 3000)
    items = [(i, make(int(rng.integers(1, 40)))) for i in range(45)]
    docs = [(i, make(int(rng.integers(0, 120)))) for i in range(700)] + [(900 + i, items[i][1]) for i in range(40)]
    got = rows(ranked_search.search(*frames(spark, items, docs), k=10))
    assert got == brute(items, docs, 10)


def test_given_documents(spark, rows):
    items, docs = table(spark, SF_DIR, "benchmark"), table(spark, SF_DIR, "documents")
    want = brute([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()], 50)
    assert rows(ranked_search.search(items, docs)) == want


def test_edges(spark, rows, edge_docs, no_docs):
    items = [(1, "the cat"), (1, "the cat"), (2, None), (3, ""), (4, "Haus Ünser 日本 x"), (5, "nothing of this"), (None, "id here"), (7, "word1 word2 more 456")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows(ranked_search.search(frame, edge_docs)) == brute([i for i in items if words(i[1])], docs, 50)
    assert rows(ranked_search.search(frame, edge_docs, k=1)) == brute([i for i in items if words(i[1])], docs, 1)
    assert ranked_search.search(frame, no_docs).count() == 0 and ranked_search.search(frame.limit(0), edge_docs).count() == 0
    same = [(i, "same text here") for i in (5, 3, None, 9, 3)]
    assert rows(ranked_search.search(*frames(spark, [(1, "text")], same + [(20, "other")]), k=3)) == brute([(1, "text")], same + [(20, "other")], 3)


def test_batches_are_pruned(spark, monkeypatch):
    """Of all pairs about the quarter with common words is scored."""
    rng = np.random.default_rng(6)
    text = lambda g, size: " ".join(f"g{g}w{int(x)}" for x in rng.integers(0, 400, size))
    rows = [{"_item": i, "_terms": ranked_search.terms(text(i % 4, 30))} for i in range(64)]
    items = ranked_search._arranged(ranked_search._items(rows), np.full(len(ranked_search._items(rows).vocabulary), 1000.0))
    place = {t: i for i, t in enumerate(items.vocabulary)}
    search = ranked_search._Search(items, 4096, 4096 * 50, 5, np.ones(64))
    winners, scored = ranked_search._Winners(search), 0
    for block in range(8):
        n = np.full(512, 50)
        own = [{place[t] for t in ranked_search.terms(text((i + block) % 4, 50)) if t in place} for i in range(512)]
        doc = np.repeat(np.arange(512), [len(x) for x in own])
        term = np.array([t for x in own for t in x], np.int64)
        values = search.contributions(n, doc, term, np.ones(len(term), np.int64))
        scored += ranked_search._search_block(search, winners, np.arange(512) + 512 * block, np.ones(512, bool), values)
    assert scored < 0.35 * 64 * 4096
