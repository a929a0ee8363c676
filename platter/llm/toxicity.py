"""Toxicity by a linear classifier with a counterfactual penalty.

A text's features are its distinct words and their beginnings. Logistic regression learns their
weights from labelled texts. In labelled sentences that name a group, the name is swapped for
those of other groups; a change of the score (before the logistic function) between the two sentences is penalised, so
that what remains for a group's name is what any group's name would get, and a neutral mention
is not taken for an attack.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import by_batch, plain_names, ready, written

# Labelled rows of each label that the weights are fitted on, about; drawn by a hash of the text. Counts of
# features and swapped sentences come from all labelled rows.
SAMPLE_ROWS = 10_000
# Features that get a weight: those whose presence says most about the label.
FEATURES = 4096
# A feature must be in so many labelled rows.
MIN_ROWS = 3
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.7

# Strength of the penalties: on weights, and on changes of the score by a swap.
RIDGE = 1e-5
COUNTERFACTUAL = 1.0
STEPS, RATE = 400, 0.1

# Entries of a task's table of counts before it is sent on.
TABLE_SIZE = 1 << 20
# Words whose features a task remembers, and how long they may be.
REMEMBERED, LONGEST = 1 << 18, 64

# Names of groups by what they distinguish, and the words that name nobody in particular.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "african", "european", "arab", "latino", "hispanic", "indigenous"),
    ("mexicans", "americans", "germans", "chinese", "russians", "turks", "indians", "french", "poles", "italians"),
    ("immigrants", "refugees", "foreigners", "migrants", "locals", "natives"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
)
NEUTRAL = ("people", "persons")

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_SWAPS = {term: tuple(t for t in (*group, *NEUTRAL) if t != term) for group in IDENTITIES for term in group}


def held_out(id_col: str) -> Column:
    """True for the third of the ids whose labels learning must not see; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _features(word: str) -> tuple[int, ...]:
    """Numbers of a word and of its beginnings; `^` tells a beginning from a whole word."""
    return (_hash(word), *(_hash("^" + word[:size]) for size in BEGINNINGS if len(word) >= size))


class _Words:
    """Features of words as places in `known` (a dictionary), or as they are without it; usual words are remembered."""

    def __init__(self, known: dict[int, int] | None = None):
        self.known, self.seen = known, {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.seen.get(word)
        if found is None:
            found = _features(word)
            if self.known is not None:
                found = tuple(self.known[f] for f in found if f in self.known)
            if len(word) <= LONGEST:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[word] = found
        return found

    def words(self, words: Iterable[str]) -> set[int]:
        return set().union(*map(self.word, set(words)))

    def text(self, text: str | None) -> set[int]:
        return self.words(_WORD.findall((text or "").lower()))


# --------------------------------------------------------------------------- counting
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows to (feature, toxic rows, clean rows), combined inside the task."""
    words = _Words()
    table: dict[int, list[int]] = {}

    def send() -> pa.RecordBatch:
        names = pa.array(list(table), pa.int64())
        counts = [pa.array([c[k] for c in table.values()], pa.int64()) for k in (1, 0)]
        table.clear()
        return pa.RecordBatch.from_arrays([names, *counts], ["feature", "toxic_rows", "clean_rows"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for f in words.text(text.as_py()):
                table.setdefault(f, [0, 0])[toxic] += 1
            if len(table) > TABLE_SIZE:
                yield send()
    yield send()


def informative(labelled: DataFrame, most: int = FEATURES) -> DataFrame:
    """(feature, gain): the features whose presence tells most about the label, by the log-likelihood ratio of all labelled rows.

    Of features that have nothing to do with the label, about one in n reaches a gain of log n; with n features tried, a
    lower gain says nothing, and such features are left out. So are those more usual in clean texts.
    """
    counts = written(
        labelled.mapInArrow(_count, "feature long, toxic_rows long, clean_rows long").groupBy("feature").agg(
            F.sum("toxic_rows").alias("a"), F.sum("clean_rows").alias("b")
        ).filter(F.col("a") + F.col("b") >= MIN_ROWS),
        "feature-counts",
    )
    least = math.log(max(counts.count(), 1))
    totals = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, rows = float(totals.t or 0), float(totals.n)

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    both, more_toxic = F.col("a") + F.col("b"), F.col("a") * F.lit(rows - toxic) > F.col("b") * F.lit(toxic)
    cells = [
        part(F.col("a"), both * F.lit(toxic) / rows), part(F.col("b"), both * F.lit(rows - toxic) / rows),
        part(F.lit(toxic) - F.col("a"), (F.lit(rows) - both) * F.lit(toxic) / rows),
        part(F.lit(rows - toxic) - F.col("b"), (F.lit(rows) - both) * F.lit(rows - toxic) / rows),
    ]
    gain = F.round(cells[0] + cells[1] + cells[2] + cells[3], 6)
    return counts.withColumn("gain", gain).filter((F.col("gain") >= least) & more_toxic).select("feature", "gain").orderBy(F.col("gain").desc(), "feature").limit(most)


# What a row of `_examples` is, besides an example of label 0 or 1.
SWAP = -1


def _examples(known: dict[int, int]):
    """(text, toxic, drawn) rows to (kind, places, removed, share), equal ones combined inside the task.

    A drawn text is an example with its places. Half of a toxic text's share goes to its telling words, each taken alone. Of every text,
    drawn or not, a swap in a sentence is a row of kind SWAP: the places added and those removed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = _Words(known), Counter()

        def send() -> pa.RecordBatch:
            keys = list(found)
            lists = [pa.array([list(k[i]) for k in keys], pa.list_(pa.int32())) for i in (1, 2)]
            shares = pa.array([float(v) for v in found.values()], pa.float64())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), *lists, shares], ["kind", "places", "removed", "share"])

        for batch in batches:
            for text, toxic, drawn in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lowered = text.as_py().lower()
                own = set(_WORD.findall(lowered))
                if drawn:
                    alone = {tuple(sorted(words.word(w))) for w in own} - {()} if toxic else ()
                    found[toxic, tuple(sorted(words.words(own))), ()] += 0.5 if alone else 1.0
                    for one in alone:
                        found[toxic, one, ()] += 0.5 / len(alone)
                if not own.isdisjoint(_SWAPS):
                    for sentence in _SENTENCE.split(lowered):
                        found.update(_sentence_swaps(_WORD.findall(sentence), words))
            if len(found) > TABLE_SIZE // 16:
                yield send()
        yield send()

    return run


def _sentence_swaps(own: list[str], words: _Words) -> Counter:
    """Every name in a sentence swapped for each other one of its kind, as (SWAP, added, removed)."""
    found, before = Counter(), words.words(own)
    for term in sorted(_SWAPS.keys() & set(own)):
        for other in _SWAPS[term]:
            after = words.words(other if w == term else w for w in own)
            if after != before:
                found[SWAP, tuple(sorted(after - before)), tuple(sorted(before - after))] += 1
    return found


# ---------------------------------------------------------------------------- fitting
@dataclass
class Model:
    """known: number of a feature to its place in the weights."""

    known: dict[int, int]
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], words: _Words) -> list[float]:
        sums = [float(np.sum(self.weights[sorted(words.text(t))])) + self.bias for t in texts]
        return (1 / (1 + np.exp(-np.clip(np.array(sums), -500, 500)))).tolist()


Sparse = tuple[np.ndarray, np.ndarray]


def sparse(lists: pa.ChunkedArray) -> Sparse:
    """(row, place) of every entry of a column of lists."""
    whole = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(whole)), sizes), whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def fit(
    texts: Sparse, toxic: np.ndarray, share: np.ndarray, size: int, added: Sparse, removed: Sparse, often: np.ndarray, penalty: float
) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression over sets of features, by full gradients with adaptive steps.

    `share` is the part of the loss that each text has, `often` that each swap has of the penalty: the mean square of the change of
    the sum of weights. Weights are never negative: no harmless words, however many, make an attack harmless.
    """
    row, feature = texts
    share = share / share.sum()
    often = penalty * often / often.sum() if len(often) else often
    weights, bias = np.zeros(size), 0.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        scores = np.bincount(row, weights[feature], len(toxic)) + bias
        error = (1 / (1 + np.exp(-np.clip(scores, -500, 500))) - toxic) * share
        slope = np.bincount(feature, error[row], size) + RIDGE * weights
        if len(often):
            change = np.bincount(added[0], weights[added[1]], len(often)) - np.bincount(removed[0], weights[removed[1]], len(often))
            pull = 2 * often * change
            slope += np.bincount(added[1], pull[added[0]], size) - np.bincount(removed[1], pull[removed[0]], size)
        slope = np.append(slope, error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = np.maximum(weights - move[:-1], 0), bias - move[-1]
    return weights, float(bias)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of all rows of `docs` with a label 0 or 1; a null text is empty. Ids with both labels count as toxic.

    Both sides are dealt by id whatever their size, so the plan does not change as labels grow.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_labelled")).agg(F.max(label_col).cast("int").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(marks.hint("merge"), F.col("_id") == F.col("_labelled")).select("text", "toxic")


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, penalty: float = COUNTERFACTUAL) -> Model:
    """The classifier from (text, toxic) rows. `penalty` 0 leaves out the counterfactual part.

    Features are chosen by counts over all rows and all swapped sentences are counted; the weights are fitted on about
    `sample_rows` rows of each label (all, if there are fewer), each label with its share of all rows. Any one attack makes a text
    toxic: half of a toxic text's part of the loss goes to its telling words, each taken alone. Rows of one label only, or none, give a constant score: 0 or 1, or 0.
    """
    ready(labelled.sparkSession)
    rows = written(labelled.select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, np.zeros(0), 1000.0 if 1 in sizes else -1000.0)
    known = {r["feature"]: i for i, r in enumerate(informative(rows, features).select("feature").collect())}
    fraction = F.when(F.col("toxic") == 1, F.lit(sample_rows / sizes[1])).otherwise(F.lit(sample_rows / sizes[0]))
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "text"), F.lit(1 << 30)) < fraction * (1 << 30)
    found = (
        rows.select("text", "toxic", drawn.alias("drawn"))
        .mapInArrow(_examples(known), "kind int, places array<int>, removed array<int>, share double")
        .groupBy("kind", "places", "removed")
        .agg(F.round(F.sum("share"), 6).alias("share"))
        .orderBy("kind", "places", "removed")
        .toArrow()
    )
    kind, share = (found.column(c).to_numpy() for c in ("kind", "share"))
    texts, swaps = found.filter(pa.array(kind != SWAP)), found.filter(pa.array(kind == SWAP))
    toxic, part = kind[kind != SWAP].astype(np.float64), share[kind != SWAP].copy()
    for label in (0, 1):
        part[toxic == label] *= sizes[label] / max(part[toxic == label].sum(), 1e-9)
    weights, bias = fit(
        sparse(texts.column("places")), toxic, part, len(known),
        sparse(swaps.column("places")), sparse(swaps.column("removed")), share[kind == SWAP] if penalty else np.zeros(0), penalty,
    )
    return Model(known, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with `score` (0 to 1) and `predicted` (1 from THRESHOLD on) in place of any such columns.

    Whole texts count, and nothing but the text; a null text is an empty one and gets the score of no features. Repeated rows get equal scores.
    An empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    given = plain_names(docs.select(*[F.col(f"`{c}`") for c in kept]))
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value.known)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = shared.value.scores(batch.column(place).to_pylist(), words)
            marks = [int(s >= THRESHOLD) for s in found]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array(marks, pa.int32())], [*batch.schema.names, "score", "predicted"]
            )

        return by_batch(one)(batches)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(run, f"{fields}, score double, predicted int").toDF(*kept, "score", "predicted")
