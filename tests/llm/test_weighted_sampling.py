import hashlib

import numpy as np
import pytest

from platter.llm import weighted_sampling as ws


def test_collisions_estimate_generalised_jaccard():
    errors = []
    for seed in range(200):
        rng = np.random.default_rng(seed)
        hashes = np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        w1 = rng.geometric(0.4, 60) - 1
        w2 = np.where(rng.random(60) < 0.5, w1, rng.geometric(0.4, 60) - 1)
        jaccard = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        a, b = ((hashes[w > 0], w[w > 0]) for w in (w1, w2))
        s1, s2 = ws.sketch_pair(a, b)
        assert (s1 == ws.signature(ws.draws(*a))).all() and (s2 == ws.signature(ws.draws(*b))).all()
        errors.append(ws.likeness(s1, s2) - jaccard)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.08


def brute(rows):
    """rows: (id, text), any order; the result in order of descending id."""
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), (r[1] or "").encode()))
    texts = [t or "" for _, t in rows]
    sigs = [ws.signature(ws.draws(*ws.terms(t))) for t in texts]
    out = []
    for k, (i, _) in enumerate(rows):
        after = (k + 1) % len(rows)
        cut = len(texts[k]) // 3
        changed = texts[k][: len(texts[k]) - cut] + texts[after][:cut]
        own = ws.signature(ws.draws(*ws.terms(changed)))
        out.append(
            (i, len(texts[k]), hashlib.sha256(changed.encode()).hexdigest(), ws.as_text(sigs[k]), ws.as_text(own),
             ws.likeness(sigs[k], own), ws.likeness(sigs[k], sigs[after]))
        )
    return sorted(out, key=repr)


def test_given_documents(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(5)
    got = ws.fingerprints(docs)
    assert rows(got) == brute([tuple(r) for r in docs.collect()])
    near = [r.near_edited for r in got.filter("n_chars > 300").collect()]
    assert 0.4 < np.mean(near) < 0.6


def test_edges(spark, rows, edge_docs, edge_rows, no_docs):
    assert rows(ws.fingerprints(edge_docs)) == brute([(i, t) for i, t, _ in edge_rows])
    assert ws.fingerprints(no_docs).count() == 0


@pytest.mark.parametrize("text", ["one", "", None])
def test_single_row(spark, rows, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows(ws.fingerprints(docs)) == brute([(1, text)])


def test_signature_round_trip():
    sig = ws.signature(ws.draws(*ws.terms("a b c d e f g")))
    assert (ws.as_signature(ws.as_text(sig)) == sig).all() and len(ws.as_text(sig)) == 4 * ws.SAMPLES
