"""Ranked lexical search of many items over all documents, exact, by dual-tree search.

Items and documents stand in two hierarchies. A node holds the largest value of each of its
members' coordinates: for items whether a term is in any of them, for documents the largest contribution of
a term in any of them. The sum over terms of the product of both bounds the score of every pair below the two
nodes; where it is below the weakest k-th score of the items below, the whole batch of pairs is left out. Contributions are
whole numbers and sums stay below 2^53, so products of matrices of doubles are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platter.llm.common import by_batch, ready, written
from platter.operators.ranking import numbered

# Items searched in one pass over the documents; more items take more passes.
ITEMS_PER_PASS = 1024
# Members of a node, from the highest level to the lowest; each is divided by the next.
ITEM_LEVELS = (16, 4, 1, 1)
DOC_LEVELS = (128, 32, 8, 1)
# Cells of the matrix of contributions that a task holds at once (8 bytes each).
CELLS = 1 << 21
# One block of documents in so many gives the first bounds on the k-th scores.
SEED_SHARE = 32
# Tasks whose winners meet first.
MERGED = 64

# Bytes of UTF-8 that belong to a term (digits, letters, everything beyond ASCII), A-Z in lower case; all else separates.
_TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_TERMS).split()


# ------------------------------------------------------------------------------ items
@dataclass
class Items:
    """A pass's items in the order of their hierarchy, and its vocabulary."""

    ids: list
    vocabulary: list[bytes]
    member: np.ndarray  # items x terms, 1.0 where the item has the term
    weight: np.ndarray | None = None  # of the terms
    levels: list[np.ndarray] = field(default_factory=list)  # coordinate maxima, a row per node


def _similar_order(member: np.ndarray, weight: np.ndarray) -> list[int]:
    """Rows in an order that keeps similar ones together: halves are split by two far apart rows, again and again."""
    rows = member * np.sqrt(np.maximum(weight, 0))
    order, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            order.extend(part.tolist())
            continue
        sub = rows[part]
        one = int(np.argmin(sub @ sub[0]))
        other = int(np.argmin(sub @ sub[one]))
        side = np.argsort(sub @ sub[one] - sub @ sub[other], kind="stable")
        half = len(part) // 2
        todo.append(part[side[:half]])
        todo.append(part[side[half:]])
    return order


def _maxima(rows: np.ndarray, size: int) -> np.ndarray:
    return rows if size == 1 else np.maximum.reduceat(rows, np.arange(0, len(rows), size), axis=0)


def _items(rows: list) -> Items:
    lists = [set(r["_terms"]) for r in rows]
    vocabulary = sorted(set().union(*lists)) if lists else []
    place = {t: i for i, t in enumerate(vocabulary)}
    member = np.zeros((len(rows), len(vocabulary)))
    for i, own in enumerate(lists):
        member[i, [place[t] for t in own]] = 1
    return Items([r["_item"] for r in rows], vocabulary, member)


def _arranged(items: Items, weight: np.ndarray) -> Items:
    order = _similar_order(items.member, weight)
    member = items.member[order]
    return Items([items.ids[i] for i in order], items.vocabulary, member, weight, [_maxima(member, size) for size in ITEM_LEVELS])


def _item_passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Distinct (id, text) rows with a term, in blocks of ITEMS_PER_PASS; only their distinct terms reach the driver."""
    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["_item", "_terms"])

    named = items.select(F.col(id_col).alias("_item"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL").distinct()
    kind = named.schema["_item"].dataType.simpleString()
    split_rows = written(named.mapInArrow(by_batch(split), f"_item {kind}, _terms array<binary>").filter("size(_terms) > 0"), "items")
    first = split_rows.limit(ITEMS_PER_PASS + 1).collect()
    if len(first) <= ITEMS_PER_PASS:
        if first:
            yield _items(sorted(first, key=lambda r: (r["_item"] is None, r["_item"] or 0, r["_terms"])))
        return
    placed = numbered(split_rows, ["_item", "_terms"], "_position")
    for start in range(0, placed.count(), ITEMS_PER_PASS):
        yield _items(placed.filter(F.col("_position").between(start, start + ITEMS_PER_PASS - 1)).orderBy("_position").collect())


# -------------------------------------------------------------------------- documents
_COUNTED = "_id long, _named boolean, _n long, _terms array<int>, _tf array<int>"


def _count(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """One row per document with a term: id, number of terms, and the counts of those that some item has.

    `_named` is false for a null id, which then counts as the largest one.
    """
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        place, rows = shared.value, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = terms(text.as_py())
            if not words:
                continue
            counts: dict[int, int] = {}
            for i in map(place.get, words):
                if i is not None:
                    counts[i] = counts.get(i, 0) + 1
            named = doc_id is not None
            rows.append((doc_id if named else (1 << 63) - 1, named, len(words), list(counts), list(counts.values())))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["_id", "_named", "_n", "_terms", "_tf"])

    return docs.mapInArrow(by_batch(run), _COUNTED)


def _document_frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; one row per term reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)[:size]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], ["term", "df"])

    rows = counted.select("_terms").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["term"]] = r["df"]
    return out


@dataclass
class _Search:
    """What a task needs to search blocks of documents."""

    items: Items
    documents: int
    words: int
    k: int
    floor: np.ndarray  # per item: scores below it cannot be among its best k

    def contributions(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """documents x terms: weight times damped count, in whole numbers."""
        m = 50 + (50 * n.astype(object) * self.documents) // self.words
        m = m.astype(np.int64)
        out = np.zeros((len(n), len(self.items.vocabulary)))
        out[doc, term] = self.items.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        return out


class _Winners:
    """The best k (score, id) of every item within a task; ties by ascending id."""

    def __init__(self, search: _Search):
        self.k, self.floor = search.k, search.floor.astype(np.float64).copy()
        self.found: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.floor]
        self.sizes = np.zeros(len(self.floor), np.int64)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        self.found[item].append((scores, ids, named))
        self.sizes[item] += len(scores)
        if self.sizes[item] >= 2 * self.k:
            self.shrink(item)

    def shrink(self, item: int) -> None:
        if self.found[item]:
            scores, ids, named = (np.concatenate(c) for c in zip(*self.found[item]))
            best = np.lexsort((named, ids, -scores))[: self.k]
            self.found[item] = [(scores[best], ids[best], named[best])]
            self.sizes[item] = len(best)
            if len(best) == self.k:
                self.floor[item] = max(self.floor[item], scores[best[-1]])


def _search_block(search: _Search, winners: _Winners, ids: np.ndarray, named: np.ndarray, values: np.ndarray) -> int:
    """Dual traversal of all items against a block of documents; the number of pairs scored."""
    items = search.items
    # Documents next to others with the same best group of items, so that maxima stay close to their members.
    near = values @ items.levels[0].T
    order = np.lexsort((-near.max(axis=1), near.argmax(axis=1))) if len(items.ids) else np.arange(len(ids))
    ids, named, values = ids[order], named[order], values[order]
    maxima = [_maxima(values, size) for size in DOC_LEVELS]
    last, scored = len(ITEM_LEVELS) - 1, 0
    todo = [(0, node, np.arange(len(items.levels[0]))) for node in range(len(maxima[0]))]
    while todo:
        level, node, candidates = todo.pop()
        # The node's weakest k-th score: an item's own on the lowest level, else the least of its members.
        weakest = winners.floor if ITEM_LEVELS[level] == 1 else np.minimum.reduceat(winners.floor, np.arange(0, len(items.ids), ITEM_LEVELS[level]))
        if level < last:
            bounds = items.levels[level][candidates] @ maxima[level][node]
            alive = candidates[bounds >= weakest[candidates]]
            if not len(alive):
                continue
            step = ITEM_LEVELS[level] // ITEM_LEVELS[level + 1]
            below = (alive[:, None] * step + np.arange(step)).ravel() if step > 1 else alive
            below = below[below < len(items.levels[level + 1])]
            if level + 1 < last:
                parts = DOC_LEVELS[level] // DOC_LEVELS[level + 1]
                first = node * parts
                for child in range(min(first + parts, len(maxima[level + 1])) - 1, first - 1, -1):
                    todo.append((level + 1, child, below))
            else:
                members = slice(node * DOC_LEVELS[level], (node + 1) * DOC_LEVELS[level])
                scores = items.member[below] @ values[members].T
                scored += scores.size
                for row, item in zip(scores, below.tolist()):
                    good = np.flatnonzero(row >= winners.floor[item])
                    if len(good):
                        winners.add(item, row[good], ids[members][good], named[members][good])
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], search: _Search) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, named, contributions) of as many documents as the matrix has room for."""
    most = max(1, min(1024, CELLS // max(len(search.items.vocabulary), 1)))
    for whole in batches:
        for start in range(0, whole.num_rows, most):
            batch = whole.slice(start, most)
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            n = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), search.contributions(n, doc, term, tf)


_WINNER = "_item int, _id long, _named boolean, score long, _task int"


def _winners(counted: DataFrame, search: _Search, share: int = 1) -> DataFrame:
    """The best k of every item within each task; with `share` only every so many-th block of a task is searched."""
    shared = counted.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, task = _Winners(own), TaskContext.get().partitionId()
        for number, (ids, named, values) in enumerate(_blocks(batches, own)):
            if number % share == 0:
                _search_block(own, best, ids, named, values)
        for item in range(len(own.items.ids)):
            best.shrink(item)
            for scores, ids, named in best.found[item]:
                count = len(scores)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, item), pa.int32()), pa.array(ids, pa.int64()), pa.array(named, pa.bool_()),
                        pa.array(scores.astype(np.int64)), pa.array(np.full(count, task), pa.int32()),
                    ],
                    ["_item", "_id", "_named", "score", "_task"],
                )

    return counted.mapInArrow(run, _WINNER)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(_item, _id, _named, score, rank), the best k of each item: first within groups of tasks, then of these."""
    order = [F.col("score").desc(), F.col("_id"), F.col("_named").desc()]
    for keys in ([F.col("_item"), F.col("_task") % MERGED], [F.col("_item")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found


def _one_pass(spark: SparkSession, items: Items, docs: DataFrame, k: int) -> DataFrame:
    counted = written(_count(docs, items.vocabulary), "term-counts")
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("_n"), F.lit(0)).alias("words")).first()
    found = _document_frequencies(counted, len(items.vocabulary)) if total.documents else np.zeros(len(items.vocabulary), np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(df) + 1))) for df in found], np.float64)
    items = _arranged(items, weight)
    # A score counts when it is above zero; the k-th best score of some documents is a bound for all.
    search = _Search(items, total.documents, max(total.words, 1), k, np.ones(len(items.ids)))
    seeds = _best(_winners(counted, search, SEED_SHARE), k).filter(F.col("rank") == k).select("_item", "score").collect()
    for r in seeds:
        search.floor[r["_item"]] = r["score"]
    ranked = _best(written(_winners(counted, search), "winners"), k)
    names = spark.createDataFrame([(i, name) for i, name in enumerate(items.ids)], f"_item int, _name {_kind(items.ids)}")
    return ranked.join(F.broadcast(names), "_item").select(
        F.col("_name").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.when(F.col("_named"), F.col("_id")).alias("doc_id"), "score"
    )


def _kind(ids: list) -> str:
    return "string" if any(isinstance(i, str) for i in ids) else "long"


def search(items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest score above 0, ties by ascending id.

    Terms, weights and scores are those of `terms` and `_Search.contributions`; statistics cover all documents with a
    term. Null texts have no terms and null ids come after all others. Repeated rows are documents of their own; repeated items
    (equal id and text) count once, and texts that share an id are searched each for itself. No item or no document: an
    empty result. Other columns are ignored. Every 1,024 items take one more pass over the documents.
    """
    spark = ready(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text IS NOT NULL")
    parts = [_one_pass(spark, block, given, k) for block in _item_passes(items, item_id, text_col)]
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
