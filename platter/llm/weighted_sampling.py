"""Document fingerprints by consistent weighted sampling.

A text's terms are its five-word shingles, weighted by how often they occur. For each of K
samples every term draws two gamma variates and a uniform one from a hash of itself; the term
with the smallest weighted draw is the sample. Two texts agree on a sample with the
probability of their generalised Jaccard similarity, sum of minima over sum of maxima of weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import by_batch, ready, whole_text, written

SAMPLES = 64
SHINGLE = 5
_ROWS = 256  # terms handled at once: what their draws need stays in the cache

_rng = np.random.default_rng(20240101)
_MULTIPLIERS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def terms(text: str, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles of lower-case words; fewer words make one shingle, none make none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    combined = np.full(n, width, np.uint64)
    for k in range(width):
        combined = combined * _MIX2 + hashes[k : k + n]
        combined ^= combined >> np.uint64(31)
    return np.unique(combined * _MIX, return_counts=True)


def draws(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each sample the smallest weighted draw over the terms (its logarithm), as float32.

    A draw is a function of the term and of its weight's step on the sample's scale, so
    equal minima mean the same term and step.
    """
    least = np.full(SAMPLES, np.inf, np.float32)
    for start in range(0, len(hashes), _ROWS):
        some = slice(start, start + _ROWS)
        x = hashes[some, None] * _MULTIPLIERS
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        u = x.view(np.uint16).reshape(len(x), SAMPLES, 4).astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(2**-16)
        c = np.negative(np.log(u[:, :, 0] * u[:, :, 1]))  # Gamma(2, 1)
        r = np.negative(np.log(u[:, :, 2] * u[:, :, 3]))  # Gamma(2, 1)
        x *= _MIX2
        x >>= np.uint64(40)
        rest = np.float32(1) - x.astype(np.float32) * np.float32(2**-24)  # 1 - uniform
        w = weights[some]
        if w.max() > 1:
            step = np.floor(np.log(w.astype(np.float32))[:, None] / r + (np.float32(1) - rest))
            rest += step
        found = np.log(c)
        found -= r * rest
        np.minimum(least, found.min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of each sample."""
    bits = least.view(np.uint32).astype(np.uint64) * _MIX
    return (bits >> np.uint64(48)).astype(np.uint16)


def sketch_pair(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two term tables; what both have with the same weight is drawn once."""
    (h1, w1), (h2, w2) = first, second
    _, at1, at2 = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    same = w1[at1] == w2[at2]
    at1, at2 = at1[same], at2[same]
    both = draws(h1[at1], w1[at1])
    own1, own2 = np.ones(len(h1), bool), np.ones(len(h2), bool)
    own1[at1] = own2[at2] = False
    return (
        signature(np.minimum(both, draws(h1[own1], w1[own1]))),
        signature(np.minimum(both, draws(h2[own2], w2[own2]))),
    )


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def as_signature(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
# Rows between the borders of a partition, its first and its last row.
_INNER, _FIRST, _LAST = 0, 1, 2


def _result(text: str, following: str) -> tuple[list, np.ndarray]:
    """The fields of a row but near_next, and the signature of the text."""
    changed = edited(text, following)
    own, other = sketch_pair(terms(text), terms(changed))
    digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
    return [len(text), digest, as_text(own), as_text(other), likeness(own, other)], own


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty; texts without words have one fingerprint of their own. The
    next row is the one with the next smaller id; null ids come last, equal ids in the
    order of their texts, and after the last row comes the first. Other columns are
    ignored; an empty table gives no row.

    Rows are range-partitioned by id once. Inside a partition the next row follows; of each
    partition the first and the last row are set aside and joined across the borders.
    """
    ready(docs.sparkSession)
    order = F.desc_nulls_last("_id")
    placed = (
        docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
        .repartitionByRange(order)
        .sortWithinPartitions(order, "_text")
    )
    id_type = placed.schema["_id"].dataType.simpleString()
    names = ["_id", *[f.split()[0] for f in _FIELDS.split(", ")], "kind", "part", "text"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = before = None  # (id, text) of the first row and of the row before
        waiting = own_before = None  # a row that lacks near_next only, and its signature
        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.int64(), pa.string()]
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if before is None:
                    first = row
                else:
                    fields, own = _result(before[1], row[1])
                    if waiting is not None:
                        rows.append([*waiting, likeness(own_before, own), _INNER, part, None])
                    waiting, own_before = [before[0], *fields], own
                before = row
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if before is not None:
            rows = [[d, *[None] * 6, kind, part, text] for (d, text), kind in ((first, _FIRST), (before, _LAST))]
            if waiting is not None:
                own = signature(draws(*terms(before[1])))
                rows.append([*waiting, likeness(own_before, own), _INNER, part, None])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def across(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for document, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            fields, own = _result(text, following)
            rows.append([document, *fields, likeness(own, signature(draws(*terms(following))))])
        types = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names[:7])

    schema = f"_id {id_type}, {_FIELDS}, kind int, part long, text string"
    sketched = written(placed.mapInArrow(inside, schema), "weighted-sketches")
    # One row per partition: which partition with rows comes next.
    parts = sketched.filter(F.col("kind") == _FIRST).select("part")
    in_order = Window.orderBy("part")
    around = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select("part", F.coalesce(F.lead("part").over(in_order), F.first("part").over(around)).alias("next"))
    heads = sketched.filter(F.col("kind") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("_following"))
    borders = (
        sketched.filter(F.col("kind") == _LAST)
        .select("part", "_id", "text")
        .join(following, "part")
        .join(heads, "next")
        .select("_id", "text", "_following")
        .mapInArrow(by_batch(across), f"_id {id_type}, {_FIELDS}")
    )
    inner = sketched.filter(F.col("kind") == _INNER).select(*names[:7])
    return inner.unionByName(borders).withColumnRenamed("_id", id_col)
