"""Held-out accuracy, the effect of the counterfactual penalty, and odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platter.llm import toxicity
from platter.llm.common import table
from platter.llm.queries import op12_toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = op12_toxicity(spark, SF_DIR)
    held = scored.filter("held_out").join(table(spark, SF_DIR, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.01
    assert scored.count() == table(spark, SF_DIR, "documents").count()
    assert scored.filter("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").isEmpty()


def _biased(spark):
    """Attacks that mostly name one group, neutral mentions of the other, and plain texts."""
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join(f"w{int(x)}x" for x in rng.integers(0, 500, n)).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = []
    for i in range(400):
        insult = ["vermin", "filthy"][i % 2]
        rows.append((f"{plain(20)}. muslims {insult if i % 10 else ''} {plain(5)}. {plain(10)}", 1))
        rows.append((f"{plain(20)}. christians {plain(5)}. {plain(10)}", 0))
        rows.append((f"{plain(30)}. {plain(9)}", 0))
    return spark.createDataFrame(rows, "text string, toxic int")


def test_swapped_groups_score_alike(spark):
    labelled = _biased(spark)
    with_penalty, without = (toxicity.learn(labelled, penalty=p) for p in (toxicity.COUNTERFACTUAL, 0.0))

    def scores(model):
        texts = ["the muslims came by", "the christians came by", "the muslims vermin", "the christians vermin", "came by"]
        return model.scores(texts, toxicity._Words(model.known))

    fair, biased = scores(with_penalty), scores(without)
    assert biased[0] >= 0.7 and biased[0] - biased[1] > 0.4
    assert fair[0] < 0.7 and abs(fair[0] - fair[1]) < 0.1
    assert min(fair[2:4]) >= 0.7 and abs(fair[2] - fair[3]) < 0.1


def test_weights_minimise_the_loss():
    """The weights of a small problem against every step to a neighbour."""
    texts, toxic = [[0, 1], [0], [1], [2], [], [0, 2]], np.array([1.0, 1, 0, 0, 0, 1])
    swaps = [([1], [0], 2), ([2], [0, 1], 1)]
    column = lambda lists: toxicity.sparse(pa.chunked_array([pa.array(lists, pa.list_(pa.int32()))]))
    often = np.array([s[2] for s in swaps], float)
    weights, bias = toxicity.fit(column(texts), toxic, np.ones(6), 3, column([s[0] for s in swaps]), column([s[1] for s in swaps]), often, 0.05)

    def loss(w, b):
        s = np.array([sum(w[f] for f in t) for t in texts]) + b
        share = 1 / 6
        fit = (share * (np.log1p(np.exp(s)) - toxic * s)).sum()
        changes = [(sum(w[f] for f in a) - sum(w[f] for f in r)) ** 2 * n / 3 for a, r, n in swaps]
        return fit + 0.05 * sum(changes) + toxicity.RIDGE / 2 * (w**2).sum()

    best = loss(weights, bias)
    for k in range(3):
        for step in (-0.02, 0.02):
            moved = weights.copy()
            moved[k] = max(moved[k] + step, 0)
            assert loss(moved, bias) >= best - 1e-4
    assert loss(weights, bias + 0.02) >= best - 1e-4 and loss(weights, bias - 0.02) >= best - 1e-4


def test_counts(spark):
    rows = [("Bad bad apple", 1), ("bad pear", 1), ("apple pear", 0), ("", 0), ("bad", 1)]
    counted = spark.createDataFrame(rows, "text string, toxic int").mapInArrow(toxicity._count, "feature long, toxic_rows long, clean_rows long")
    got = {r[0]: (r[1], r[2]) for r in counted.groupBy("feature").agg(F.sum("toxic_rows"), F.sum("clean_rows")).collect()}
    assert got[toxicity._hash("bad")] == (3, 0) and got[toxicity._hash("^appl")] == (1, 1) and got[toxicity._hash("pear")] == (1, 1)
    assert toxicity._hash("^bad") not in got


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, 0), (1, 1), (5, 0), (None, 1), (9, 1), (4, 2), (6, None)]])
def test_edges(spark, edge_docs, no_docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    for docs in (edge_docs, no_docs):
        model = toxicity.learn(toxicity.labelled_texts(docs, marks))
        scored = toxicity.score(docs.withColumn("a.b", F.lit(1)), model)
        assert scored.columns == [c for c in edge_docs.columns if c not in ("score", "predicted")] + ["a.b", "score", "predicted"]
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.text == ""} | {r.score for r in rows if r.text is None}) <= 1


def test_long_and_unusual_texts(spark):
    model = toxicity.learn(_biased(spark))
    texts = ["x " * 2_000_000 + "vermin", "VERMIN!!", "\ud800 vermin", "a" * 1_000_000, "!!!"]
    found = model.scores(texts, toxicity._Words(model.known))
    assert min(found[:3]) >= 0.7 and max(found[3:]) < 0.7
