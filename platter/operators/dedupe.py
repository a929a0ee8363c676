"""Exact and near duplicate removal and diverse selection over bounded per-query pools.

A pool never exceeds the widest retrieval level, so the order-dependent part runs
as one small group per query and parallelises over queries.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions import text as X
from platter.operators.ranking import first_per_key

# Thresholds of the selection.
TEXT_DUPLICATE = 0.75
VECTOR_DUPLICATE = 0.70
DOMINANT_SHARE = 0.60
MAX_SAME_PATTERN = 2
FINAL_K = 5
LEVELS = (100, 500, 1000, 2500, 5000)


def with_text_features(candidates: DataFrame) -> DataFrame:
    """Adds the normalised text, its distinct tokens and its review pattern."""
    return (
        candidates.withColumn("normalized", X.normalize_text(F.col("comment")))
        .withColumn("tokens", X.tokens(F.col("normalized")))
        .withColumn("pattern", X.review_pattern(F.col("tokens")))
    )


def exact_dedupe(candidates: DataFrame) -> DataFrame:
    """Best-scored row per query and normalised text; rows without text are removed.

    The text is keyed by a digest; only one row per key leaves each task.
    """
    keyed = candidates.withColumn("_digest", F.sha2("normalized", 256))
    best = first_per_key(keyed, ["query_id", "_digest"], [F.col("score").desc(), F.col("review_id")])
    # Emptiness is tested on the ranked rows: a filter further up would be pushed to
    # the review scan and normalise every text of the table.
    return best.filter(F.col("normalized") != "").drop("_digest")


# ------------------------------------------------------------------ per-query helpers
class NearDuplicateFilter:
    """Finds the first kept token set that has Jaccard >= threshold with a given one.

    Kept sets are found through their rarest tokens: two sets that similar must
    share one of the first |x| - ceil(t |x|) + 1 tokens in rarity order.
    """

    def __init__(self, pool: Iterable[Sequence[str]], threshold: float):
        self.threshold = threshold
        self.frequency = Counter(t for tokens in pool for t in tokens)
        self.index: dict[str, list[int]] = defaultdict(list)
        self.kept: list[tuple[int, frozenset[str]]] = []

    def _rare_tokens(self, tokens: Sequence[str]) -> list[str]:
        ordered = sorted(tokens, key=lambda t: (self.frequency[t], t))
        # The product is rounded down a little: 0.55 * 100 must count as 55.
        return ordered[: len(ordered) - math.ceil(self.threshold * len(ordered) - 1e-9) + 1]

    def match(self, tokens: Sequence[str]) -> int | None:
        """Key of the first kept set that is too similar."""
        own = frozenset(tokens)
        if not own:  # two empty sets are alike
            return next((key for key, other in self.kept if not other), None)
        found = {k for t in self._rare_tokens(tokens) for k in self.index[t]}
        for k in sorted(found):
            key, other = self.kept[k]
            common = len(own & other)
            if common / (len(own) + len(other) - common) >= self.threshold:
                return key
        return None

    def keep(self, key: int, tokens: Sequence[str]) -> None:
        for t in self._rare_tokens(tokens):
            self.index[t].append(len(self.kept))
        self.kept.append((key, frozenset(tokens)))


def _jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    if not a and not b:
        return 1.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def token_hashes() -> Column:
    """The tokens as 64-bit hashes: what leaves the JVM and is shuffled is eight bytes a word."""
    return F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")


def _unit(vector) -> np.ndarray | None:
    if vector is None:
        return None
    v = np.asarray(vector, dtype=np.float64)
    length = np.linalg.norm(v)
    return v / length if length > 0 else v


@dataclass(frozen=True)
class Selection:
    """Settings of the diverse selection."""

    text_duplicate: float = TEXT_DUPLICATE
    vector_duplicate: float = VECTOR_DUPLICATE
    dominant_share: float = DOMINANT_SHARE
    max_same_pattern: int = MAX_SAME_PATTERN
    final_k: int = FINAL_K
    levels: tuple[int, ...] = LEVELS


def near_unique(pool: pd.DataFrame, threshold: float) -> list[int | None]:
    """Per row, in pool order, the position of the kept row it repeats; None when it is kept itself."""
    near = NearDuplicateFilter(pool["tokens"], threshold)
    verdict: list[int | None] = []
    for position, tokens in enumerate(pool["tokens"]):
        verdict.append(near.match(tokens))
        if verdict[-1] is None:
            near.keep(position, tokens)
    return verdict


class Features:
    """Word sets and unit vectors of a pool's rows, made when first asked for and kept."""

    def __init__(self, pool: pd.DataFrame):
        self._tokens, self._embeddings = list(pool["tokens"]), list(pool["embedding"])
        self.patterns = list(pool["pattern"])
        self.words = cache(lambda i: frozenset(self._tokens[i]))
        self.vector = cache(lambda i: _unit(self._embeddings[i]))


def pick_diverse(rows: Sequence[int], features: Features, settings: Selection) -> tuple[list[int], list[str]]:
    """The picked ones of some rows of a pool, in pick order, and the rows' dominant patterns.

    The first sweep limits dominant patterns; the second, only when picks are
    missing, does not. Both refuse rows too similar to a pick by words or vector.
    """
    share = Counter(features.patterns[i] for i in rows)
    dominant = sorted(p for p, n in share.items() if n / len(rows) >= settings.dominant_share)
    picked: list[int] = []
    used: Counter[str] = Counter()

    def alike(i: int, j: int) -> bool:
        if _jaccard(features.words(i), features.words(j)) >= settings.text_duplicate:
            return True
        a, b = features.vector(i), features.vector(j)
        return a is not None and b is not None and round(float(a @ b), 9) >= settings.vector_duplicate

    def too_similar(i: int) -> bool:
        return any(alike(i, j) for j in picked)

    for capped in (True, False):
        for i in rows:
            pattern = features.patterns[i]
            if len(picked) >= settings.final_k:
                break
            if i in picked or (capped and pattern in dominant and used[pattern] >= settings.max_same_pattern):
                continue
            if not too_similar(i):
                picked.append(i)
                used[pattern] += 1
    return picked, dominant


# ----------------------------------------------------------------- grouped operators
def _by_score(pool: pd.DataFrame) -> pd.DataFrame:
    return pool.sort_values(["score", "review_id"], ascending=[False, True], ignore_index=True)


def near_dedupe(candidates: DataFrame, threshold: float = TEXT_DUPLICATE) -> DataFrame:
    """(query_id, review_id, duplicate_of): greedy in score order against kept rows.

    ``duplicate_of`` is NULL for kept rows, else the first kept row that is too
    similar. One output row per candidate.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = _by_score(pool)
        ids = pool["review_id"]
        repeats = [None if v is None else int(ids[v]) for v in near_unique(pool, threshold)]
        return pd.DataFrame(
            {"query_id": pool["query_id"], "review_id": ids, "duplicate_of": pd.array(repeats, dtype="Int64")}
        )

    return (
        candidates.select("query_id", "review_id", "score", token_hashes())
        .groupBy("query_id")
        .applyInPandas(run, "query_id bigint, review_id bigint, duplicate_of bigint")
    )


def diverse_select(candidates: DataFrame, settings: Selection = Selection()) -> DataFrame:
    """(query_id, pick, review_id, pattern): at most ``final_k`` varied rows per query, in pick order."""

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = _by_score(pool)
        picked, _ = pick_diverse(range(len(pool)), Features(pool), settings)
        chosen = pool.iloc[picked]
        return pd.DataFrame(
            {
                "query_id": chosen["query_id"],
                "pick": range(1, len(chosen) + 1),
                "review_id": chosen["review_id"],
                "pattern": chosen["pattern"],
            }
        )

    return (
        candidates.select("query_id", "review_id", "score", token_hashes(), "pattern", "embedding")
        .groupBy("query_id")
        .applyInPandas(run, "query_id bigint, pick int, review_id bigint, pattern string")
    )


_STAGE_SCHEMA = (
    "query_id bigint, level int, stopped_early boolean, distinct_texts int, near_duplicates_removed int, "
    "selected array<bigint>, dominant_patterns array<string>, distribution map<string, int>"
)


def progressive_select(pool: DataFrame, questions: DataFrame, settings: Selection = Selection()) -> DataFrame:
    """Per question the best selection over widening levels, with diagnostics of the last stage tried.

    ``pool`` holds hydrated, intent-filtered, exact-deduplicated candidates with
    the rank of the vector search; a level is a prefix of that ranking. The
    search stops at the first level that fills the selection, else the largest
    selection counts, the first on ties. A question without candidates has tried all
    levels and selected nothing.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = _by_score(rows)
        kept = np.array([v is None for v in near_unique(rows, settings.text_duplicate)])
        features, ids = Features(rows), rows["review_id"]
        best: list[int] = []
        report = None
        for level in settings.levels:
            inside = rows["rank"].to_numpy() <= level
            unique = np.flatnonzero(inside & kept).tolist()
            picked, dominant = pick_diverse(unique, features, settings)
            chosen = [int(ids[i]) for i in picked]
            if len(chosen) > len(best):
                best = chosen
            full = len(chosen) >= settings.final_k
            patterns = dict(Counter(features.patterns[i] for i in unique))
            report = (level, full, int(inside.sum()), int(inside.sum()) - len(unique), dominant, patterns)
            if full:
                break
        level, full, distinct, removed, dominant, patterns = report
        return pd.DataFrame(
            {
                "query_id": [int(rows["query_id"].iloc[0])],
                "level": [level],
                "stopped_early": [full],
                "distinct_texts": [distinct],
                "near_duplicates_removed": [removed],
                "selected": [best],
                "dominant_patterns": [dominant],
                "distribution": [patterns],
            }
        )

    stages = (
        pool.select("query_id", "review_id", "rank", "score", token_hashes(), "pattern", "embedding")
        .groupBy("query_id")
        .applyInPandas(run, _STAGE_SCHEMA)
    )
    nothing = {
        "level": F.lit(settings.levels[-1]),
        "stopped_early": F.lit(False),
        "distinct_texts": F.lit(0),
        "near_duplicates_removed": F.lit(0),
        "selected": F.array().cast("array<bigint>"),
        "dominant_patterns": F.array().cast("array<string>"),
        "distribution": F.create_map().cast("map<string, int>"),
    }
    return questions.select("query_id").join(stages, "query_id", "left").select(
        "query_id", *[F.coalesce(name, other).alias(name) for name, other in nothing.items()]
    )


def mmr_rerank(
    candidates: DataFrame, keep: int = FINAL_K, relevance_weight: float = 0.70, pool_size: int = 40
) -> DataFrame:
    """(query_id, pick, review_id): maximal marginal relevance over the first ``pool_size`` candidates.

    Each pick maximises weight * score - (1 - weight) * largest cosine to the picks so far.
    """

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = _by_score(pool)
        vectors = np.stack([_unit(v) for v in pool["embedding"]])
        similar = np.round(vectors @ vectors.T, 9)
        scores, left, picked = pool["score"].to_numpy(), list(range(len(pool))), []
        while left and len(picked) < keep:
            closeness = similar[np.ix_(left, picked)].max(axis=1) if picked else np.zeros(len(left))
            value = np.round(relevance_weight * scores[left] - (1 - relevance_weight) * closeness, 9)
            picked.append(left.pop(int(np.argmax(value))))
        chosen = pool.iloc[picked]
        return pd.DataFrame(
            {"query_id": chosen["query_id"], "pick": range(1, len(chosen) + 1), "review_id": chosen["review_id"]}
        )

    return (
        candidates.filter((F.col("rank") <= pool_size) & F.col("embedding").isNotNull())
        .select("query_id", "review_id", "score", "embedding")
        .groupBy("query_id")
        .applyInPandas(run, "query_id bigint, pick int, review_id bigint")
    )
