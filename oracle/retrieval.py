"""DuckDB statements of loads, text, vector, retrieval and streaming queries."""

from __future__ import annotations

import numpy as np

from oracle.base import TRIM, half_up, not_blank, text, text_list
from oracle.statements import SQL, add
from platter.functions.text import ASPECTS, INTENT_PHRASES, SPACE_CLASS, TERM_FAMILIES
from platter.operators import batching, dedupe
from platter.plans.catalogue import RESTAURANT_MEASURES
from platter.plans.retrieval import EVIDENCE_TEXT_LENGTH, MIN_RELEVANCE, NO_EVIDENCE, SCORE_WINDOW
from platter.sources.sample import LETTERS

# ---------------------------------------------------------------- loads and copies
_MONEY = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in ("subtotal", "discount", "delivery_fee", "gst", "sales_amount")
)
add("load_csv_roundtrip", f"SELECT * REPLACE ({_MONEY}) FROM raw_orders")
add("load_csv_texts", "SELECT review_id, rating, comment FROM raw_reviews")
add("load_menu_coerced", "SELECT * REPLACE (TRY_CAST(price AS DOUBLE) AS price) FROM raw_menu")
SQL["bronze_copy"] = SQL["table_row_counts"]
add(
    "lookup_by_ids",
    """SELECT review_id, rating, review_date FROM raw_reviews
WHERE CAST(review_id AS VARCHAR) IN (SELECT review_id FROM review_enriched)""",
)
add(
    "review_dates",
    """SELECT review_id, CASE WHEN review_id % 11 = 0 OR review_id % 13 = 0 THEN NULL ELSE review_date END AS review_date
FROM raw_reviews""",
)
add("embedding_batch_scan", "SELECT review_id, comment FROM raw_reviews JOIN embeddings ON review_id = vec_id")

# ---------------------------------------------------------------- ordering, batches
add(
    "first_n_reviews",
    """SELECT CAST(review_id AS VARCHAR) AS review_id, rating, comment FROM usable ORDER BY CAST(review_id AS VARCHAR) LIMIT 100""",
)
add("keyset_page", "SELECT review_id, rating, comment FROM usable ORDER BY review_id LIMIT 50 OFFSET 100")
_STRATUM = {"positive": "rating >= 4", "negative": "rating <= 2", "medium": "rating = 3", "random": "true"}
add(
    "stratified_sample",
    " UNION ALL ".join(
        f"""(SELECT '{name}' AS stratum, review_id, rating, comment
FROM (SELECT *, (review_id % 2147483647 * 1103515245 + 7 * 12345) % 2147483647 AS x FROM usable) WHERE {_STRATUM[name]}
ORDER BY x * x % 2147483647, review_id LIMIT {n})"""
        for name, n in batching.STRATA.items()
    ),
)
add(
    "shard_reviews",
    """SELECT CAST(review_id % 4 + 1 AS INT) AS worker, count(*) AS reviews, min(review_id) AS first_id, max(review_id) AS last_id
FROM usable GROUP BY 1""",
)
add(
    "batch_reviews",
    """SELECT worker, CAST(position // 15 + 1 AS BIGINT) AS batch_no, CAST(count(*) AS INT) AS reviews,
  string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY review_id) AS review_ids,
  md5(string_agg(concat_ws('|', review_id, rating, comment), chr(10) ORDER BY review_id)) AS contents
FROM (SELECT *, CAST(review_id % 3 + 1 AS INT) AS worker, row_number() OVER (PARTITION BY review_id % 3 ORDER BY review_id) - 1 AS position
      FROM usable) GROUP BY worker, position // 15""",
)

# ------------------------------------------------------------------ text operators
_FAMILY = {name: f"list_has_any(tokens, {text_list(terms)})" for name, terms in TERM_FAMILIES.items()}
NORMALIZED = {
    "normalized_reviews": f"""SELECT review_id, comment,
  trim(regexp_replace(trim(regexp_replace(lower(coalesce(comment, '')), '[{SPACE_CLASS}]+', ' ', 'g'), ' '), '[^\\p{{L}}\\p{{N}}_ ]', '', 'g'), ' ') AS normalized
FROM raw_reviews""",
    "featured": """SELECT review_id, comment, normalized,
  list_filter(list_distinct(string_split_regex(normalized, ' +')), lambda t: t <> '') AS tokens FROM normalized_reviews""",
    "patterned": f"""SELECT *, coalesce(nullif(array_to_string(list_filter([{', '.join(
        f"CASE WHEN {_FAMILY[n]} THEN '{n}' END" for n in sorted(_FAMILY))}], lambda p: p IS NOT NULL), '|'), ''), 'other') AS pattern
FROM featured""",
}
add("normalize_text", "SELECT review_id, normalized, CAST(len(tokens) AS INT) AS token_count FROM featured", **NORMALIZED)
add(
    "token_jaccard",
    """SELECT review_id, CASE WHEN n = 0 THEN 1.0 ELSE common / n END AS similarity FROM (
  SELECT a.review_id, CAST(len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) AS common,
    CAST(len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) AS n
  FROM featured a JOIN featured b ON a.review_id = b.review_id + 1)""",
    **NORMALIZED,
)
CORPUS = {
    **NORMALIZED,
    "token_sets": "SELECT f.review_id, list_sort(tokens) AS tokens FROM featured f JOIN usable USING (review_id)",
    "token_classes": "SELECT tokens, min(review_id) AS class_id, count(*) AS class_size FROM token_sets GROUP BY tokens",
    "alike": f"""SELECT a.class_id AS left_id, b.class_id AS right_id,
    CAST(len(list_intersect(a.tokens, b.tokens)) AS DOUBLE) AS common, CAST(len(a.tokens) + len(b.tokens) AS DOUBLE) AS total
  FROM token_classes a JOIN token_classes b ON a.class_id < b.class_id AND len(a.tokens) > 0
    AND len(a.tokens) >= {dedupe.TEXT_DUPLICATE} * len(b.tokens) - 1e-9 AND len(b.tokens) >= {dedupe.TEXT_DUPLICATE} * len(a.tokens) - 1e-9""",
    "similar_pairs": f"""SELECT left_id, right_id, common / (total - common) AS similarity FROM alike
  WHERE common / (total - common) >= {dedupe.TEXT_DUPLICATE}::DOUBLE""",
}
add("near_duplicate_pairs", "SELECT left_id, right_id, similarity FROM similar_pairs", **CORPUS)
add(
    "near_duplicate_classes",
    """SELECT s.review_id, c.class_id, c.class_size, (SELECT count(*) FROM similar_pairs p WHERE p.left_id = c.class_id OR p.right_id = c.class_id) AS links
FROM token_sets s JOIN token_classes c ON s.tokens = c.tokens""",
    **CORPUS,
)
add("term_match", f"SELECT review_id, {', '.join(f'{e} AS {n}' for n, e in _FAMILY.items())} FROM featured", **NORMALIZED)
add("review_pattern", "SELECT review_id, pattern FROM patterned", **NORMALIZED)
add(
    "pattern_distribution",
    f"""SELECT pattern, reviews, {half_up('reviews', 'total', 4)} AS share, reviews / total >= {dedupe.DOMINANT_SHARE} AS dominant
FROM (SELECT pattern, count(*) AS reviews, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM patterned GROUP BY pattern)""",
    **NORMALIZED,
)
add(
    "duplicate_comment_stats",
    f"""SELECT count(*) AS total_comments, count(DISTINCT trim(comment, {TRIM})) AS unique_comments,
  count(*) - count(DISTINCT trim(comment, {TRIM})) AS duplicate_comments FROM raw_reviews WHERE comment IS NOT NULL""",
)


def intents(source: str) -> str:
    """The question table with one boolean per intent."""
    flags = {
        name: "(" + " OR ".join(f"contains(q, {text(p)})" for p in phrases) + ")"
        for name, phrases in INTENT_PHRASES.items()
    }
    columns = ", ".join(f"{flag} AS wants_{name}" for name, flag in flags.items())
    general = "NOT (" + " OR ".join(flags.values()) + ") AS wants_general"
    return f"""SELECT * EXCLUDE (question, q), {columns}, {general} FROM (SELECT *,
  trim(regexp_replace(trim(regexp_replace(lower(question), '[{SPACE_CLASS}]+', ' ', 'g'), ' '), '[^\\p{{L}}\\p{{N}}_ ]', '', 'g'), ' ') AS q
FROM {source})"""


add("query_intents", intents("question_log"))

# ----------------------------------------------------------------- embedding table
BATCHES = {
    "vector_batches": """SELECT vec_id AS review_id, CAST(embedding AS DOUBLE[]) AS embedding, 0 AS batch FROM embeddings
UNION ALL SELECT vec_id, list_reverse(CAST(embedding AS DOUBLE[])), 1 FROM embeddings WHERE label = 0""",
}


def digest(vector: str) -> str:
    return f"""CAST(len({vector}) AS INT) AS dimension, round({vector}[1], 6) AS first_value, round({vector}[-1], 6) AS last_value,
  round(list_sum({vector}), 6) AS total, round(sqrt(list_dot_product({vector}, {vector})), 6) AS length"""


add(
    "embedding_quality",
    """SELECT count(*) AS vectors, count(*) FILTER (vec_id % 50 = 1) AS missing_vector, count(*) FILTER (vec_id % 50 = 2) AS wrong_dimension,
  count(*) FILTER (vec_id % 50 = 3) AS non_finite, count(*) FILTER (vec_id % 50 = 4) AS zero_norm FROM embeddings""",
)
add(
    "embedding_quarantine",
    """SELECT vec_id AS review_id, CASE vec_id % 50 WHEN 1 THEN 'missing_vector' WHEN 2 THEN 'wrong_dimension' WHEN 3 THEN 'non_finite'
  ELSE 'zero_norm' END AS problems FROM embeddings WHERE vec_id % 50 BETWEEN 1 AND 4""",
)
add(
    "embedding_normalize",
    f"""SELECT review_id, {digest('u')} FROM (SELECT review_id, list_transform(embedding,
  lambda x: 3 * x / sqrt(9 * list_dot_product(embedding, embedding))) AS u FROM review_embeddings)""",
)
add("index_dedupe", f"""SELECT review_id, batch, {digest('embedding')} FROM vector_batches
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY batch) = 1""", **BATCHES)
add(
    "index_first_in_file",
    f"""SELECT review_id, copy, {digest('embedding')} FROM (SELECT vec_id AS review_id, CAST(CASE WHEN label = 0 THEN 0 ELSE 1 END AS INT) AS copy,
  CASE WHEN label = 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS embedding FROM embeddings)""",
)
add(
    "index_metadata",
    """SELECT count(*) AS source_reviews_loaded, count(*) - count(DISTINCT review_id) AS duplicates_removed,
  count(DISTINCT review_id) AS final_reviews, CAST(64 AS INT) AS dimension, 'cosine' AS metric, bool_and(len(embedding) = 64) AS dimension_ok
FROM vector_batches""",
    **BATCHES,
)
add(
    "index_validation",
    """SELECT count(*) = (SELECT count(*) FROM embeddings) AS rows_ok, count(DISTINCT review_id) = (SELECT count(*) FROM embeddings) AS ids_ok,
  bool_and(len(unit) = 64) AS dimension_ok, bool_and(abs(sqrt(list_dot_product(unit, unit)) - 1) < 1e-6) AS normalized_ok
FROM (SELECT review_id, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS unit
      FROM review_embeddings WHERE list_dot_product(embedding, embedding) > 0)""",
)
add("vector_upsert", f"""SELECT review_id, batch AS version, {digest('embedding')} FROM vector_batches
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY batch DESC) = 1""", **BATCHES)
add(
    "ingest_violations",
    """SELECT batch, CAST(sum(copies) AS BIGINT) AS rows, CAST(sum(CASE WHEN review_id IS NULL THEN copies ELSE 0 END) AS BIGINT) AS null_ids,
  CAST(sum(CASE WHEN review_id IS NOT NULL THEN copies - 1 ELSE 0 END) AS BIGINT) AS duplicate_ids,
  CAST(sum(nulls) AS BIGINT) AS null_comments, CAST(sum(blanks) AS BIGINT) AS blank_comments,
  sum(CASE WHEN review_id IS NULL THEN copies ELSE copies - 1 END + nulls + blanks) = 0 AS accepted
FROM (SELECT batch, review_id, count(*) AS copies, count(*) FILTER (comment IS NULL) AS nulls,
        count(*) FILTER (comment IS NOT NULL AND NOT usable_comment) AS blanks FROM arrivals GROUP BY batch, review_id) GROUP BY batch""",
    arrivals=f"""SELECT review_id // 100 AS batch, review_id, comment, {not_blank('comment')} AS usable_comment FROM raw_reviews
UNION ALL SELECT review_id // 100, CASE WHEN review_id % 3 <> 0 THEN review_id END, comment, {not_blank('comment')} FROM raw_reviews
WHERE review_id // 100 = 1""",
)
add(
    "index_coverage",
    f"""SELECT *, {half_up('100 * embedded_reviews', 'usable_reviews', 2)} AS embedded_percent,
  {half_up('100 * enriched_reviews', 'usable_reviews', 2)} AS enriched_percent
FROM (SELECT (SELECT count(*) FROM usable) AS usable_reviews, (SELECT count(*) FROM embeddings) AS vectors,
  (SELECT count(*) FROM usable WHERE review_id IN (SELECT vec_id FROM embeddings)) AS embedded_reviews,
  (SELECT count(*) FROM usable WHERE CAST(review_id AS VARCHAR) IN (SELECT review_id FROM review_enriched)) AS enriched_reviews,
  (SELECT count(*) FROM usable WHERE review_id IN (SELECT vec_id FROM embeddings)
     AND CAST(review_id AS VARCHAR) IN (SELECT review_id FROM review_enriched)) AS embedded_and_enriched,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT review_id FROM usable)) AS vectors_without_review)""",
)

# ------------------------------------------------------------------------ retrieval
RANKED = {
    "ranked": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS INT) AS rank FROM scored
QUALIFY rank <= 5000""",
    "relevant": f"""SELECT *, greatest({MIN_RELEVANCE}::DOUBLE, round(max(score) OVER (PARTITION BY query_id) - {SCORE_WINDOW}::DOUBLE, 9)) AS threshold
FROM ranked QUALIFY score >= threshold""",
    "details": """SELECT r.review_id, r.rating, r.comment, r.review_date, e.sentiment_label, e.score_100 / 100.0 AS sentiment_score, e.topic, e.key_issue
FROM raw_reviews r LEFT JOIN latest_enrichment e ON e.review_id = CAST(r.review_id AS VARCHAR)""",
    "hydrated": "SELECT * FROM relevant JOIN details USING (review_id)",
    "hydrated_wide": "SELECT * FROM ranked JOIN details USING (review_id)",
    "left_ranked": """SELECT query_id, rank, review_id, score, rating, comment, review_date FROM ranked LEFT JOIN raw_reviews USING (review_id)
WHERE rank <= 20""",
    "intents": intents("questions"),
    "rated": """SELECT h.* FROM hydrated h JOIN intents i USING (query_id)
WHERE CASE WHEN wants_rating_low THEN rating <= 2 WHEN wants_rating_high THEN rating >= 4 ELSE true END""",
}


def _wanted(name: str) -> str:
    if name in ASPECTS:
        return f"wants_{name}"
    return "wants_positive AND NOT wants_negative" if name == "positive" else "wants_negative OR wants_problem"


_TERM_RULE = " OR ".join(f"(({_wanted(n)}) AND {_FAMILY[n]})" for n in _FAMILY)
_NO_TERMS = "NOT (" + " OR ".join(f"({_wanted(n)})" for n in _FAMILY) + ")"
RANKED["intent_hits"] = f"""SELECT r.*, f.normalized, f.tokens, f.pattern FROM {{}} r JOIN patterned f USING (review_id)
JOIN intents i USING (query_id) WHERE {_NO_TERMS} OR {_TERM_RULE}"""


def stage(**changes: str) -> dict[str, str]:
    return {**NORMALIZED, **RANKED, **changes}


add("vector_topk", "SELECT query_id, review_id, score, rank FROM ranked WHERE rank <= 5", **stage())
SQL["vector_topk_all_cells"] = SQL["vector_topk"]
SQL["vector_topk_all_lists"] = SQL["vector_topk"]
add(
    "vector_topk_lists",
    """SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) AS queries,
  CAST((SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * least(10, count(*)) AS BIGINT) AS expected, count(*) AS table_rows, count(*) AS indexed_rows,
  true AS recall_reached, true AS under_half FROM embeddings""",
)
# Six planes serve all tables up to 4096 x 127 vectors; their values come from the seed.
_BITS, _PROBES = 6, 16
_DIMENSION = 64
_PLANES = np.random.default_rng(42).standard_normal((_DIMENSION, _BITS)).T.tolist()
_SIDES = "[" + ", ".join(f"list_dot_product(embedding, {plane}::DOUBLE[])" for plane in _PLANES) + "]"
_OWN = " + ".join(f"CASE WHEN sides[{b + 1}] >= 0 THEN {1 << b} ELSE 0 END" for b in range(_BITS))
_COST = " + ".join(f"CASE WHEN (flip >> {b}) & 1 = 1 THEN abs(sides[{b + 1}]) ELSE 0 END" for b in range(_BITS))
add(
    "vector_topk_lsh",
    """SELECT r.query_id, count(*) AS expected, count(f.review_id) AS hit, (SELECT count(*) FROM review_embeddings) AS table_rows,
  (SELECT count(*) FROM probed_rows n WHERE n.query_id = r.query_id) AS rows_scored
FROM ranked r LEFT JOIN probed_best f ON f.query_id = r.query_id AND f.review_id = r.review_id WHERE r.rank <= 5 GROUP BY r.query_id""",
    **stage(
        query_sides=f"SELECT query_id, {_SIDES} AS sides FROM query_embeddings",
        probed=f"""SELECT query_id, xor({_OWN}, flip) AS cell FROM query_sides, (SELECT CAST(unnest(range({1 << _BITS})) AS INT) AS flip)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_COST}, flip) <= {_PROBES}""",
        placed=f"SELECT review_id, {_OWN} AS cell FROM (SELECT review_id, {_SIDES} AS sides FROM review_embeddings)",
        probed_rows="SELECT p.query_id, c.review_id FROM probed p JOIN placed c USING (cell)",
        probed_best="""SELECT s.query_id, s.review_id FROM scored s JOIN probed_rows n ON n.query_id = s.query_id AND n.review_id = s.review_id
  QUALIFY row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.review_id) <= 5""",
    ),
)
add("adaptive_threshold", "SELECT query_id, review_id, score, rank, threshold FROM relevant", **stage())
add("hydrate_candidates", "SELECT * EXCLUDE (threshold) FROM hydrated", **stage())
add("hydrate_left_ranked", "SELECT * FROM left_ranked", **stage())
add(
    "retrieval_diagnostics",
    f"""SELECT query_id, count(*) AS results, min(score) AS min_score, max(score) AS max_score, count(c) AS mapped_count,
  count(DISTINCT c) AS unique_comments, round(avg(score), 6) AS avg_score,
  CASE WHEN max(score) < 0.40 THEN 'weak' WHEN max(score) < 0.50 THEN 'below 0.50' ELSE 'strong' END AS strength
FROM (SELECT *, nullif(trim(coalesce(comment, ''), {TRIM}), '') AS c FROM left_ranked) GROUP BY query_id""",
    **stage(),
)
add(
    "evidence_validity",
    f"""SELECT query_id, count(*) AS review_count, '' AS missing_columns, count(*) - count(DISTINCT review_id) AS duplicate_review_ids,
  count(*) FILTER (NOT coalesce({not_blank('comment')}, false)) AS empty_comments, count(*) = count(DISTINCT review_id) AS valid
FROM left_ranked GROUP BY query_id""",
    **stage(),
)
add("intent_rating_filter", "SELECT query_id, review_id, rating FROM rated", **stage())
add(
    "intent_term_filter",
    "SELECT query_id, review_id, pattern FROM intent_hits",
    **stage(intent_hits=RANKED["intent_hits"].format("hydrated")),
)


def pools(source: str, with_intents: bool) -> dict[str, str]:
    """Exact-deduplicated pools with similarity lists and the greedy near-duplicate pass."""
    rows = (
        RANKED["intent_hits"].format("rated")
        if with_intents
        else f"SELECT r.*, f.normalized, f.tokens, f.pattern FROM {source} r JOIN patterned f USING (review_id)"
    )
    return stage(
        intent_hits=rows,
        exact="""SELECT * FROM intent_hits WHERE normalized <> ''
QUALIFY row_number() OVER (PARTITION BY query_id, normalized ORDER BY score DESC, review_id) = 1""",
        pool_words="""SELECT review_id, len(tokens) AS n, unnest(tokens) AS word FROM (SELECT DISTINCT review_id, tokens FROM exact)""",
        text_pairs=f"""SELECT a.review_id AS a, b.review_id AS b FROM pool_words a JOIN pool_words b ON a.word = b.word AND a.review_id <> b.review_id
GROUP BY a.review_id, b.review_id HAVING CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) >= {dedupe.TEXT_DUPLICATE}""",
        text_repeats="SELECT a AS review_id, list(b) AS dups FROM text_pairs GROUP BY a",
        numbered="""SELECT e.*, coalesce(t.dups, []::BIGINT[]) AS dups, CAST(row_number() OVER (PARTITION BY e.query_id ORDER BY e.score DESC, e.review_id) AS BIGINT) AS rn
FROM exact e LEFT JOIN text_repeats t USING (review_id)""",
        near_pass="""SELECT query_id, CAST(0 AS BIGINT) AS rn, []::BIGINT[] AS kept FROM (SELECT DISTINCT query_id FROM numbered)
UNION ALL SELECT s.query_id, p.rn, CASE WHEN list_has_any(s.kept, p.dups) THEN s.kept ELSE list_append(s.kept, p.review_id) END
FROM near_pass s JOIN numbered p ON p.query_id = s.query_id AND p.rn = s.rn + 1""",
        near_kept="SELECT query_id, unnest(arg_max(kept, rn)) AS review_id FROM near_pass GROUP BY query_id",
    )


_NEAR = """SELECT p.query_id, p.review_id, CASE WHEN any_value(me.review_id) IS NULL
  THEN arg_min(k.review_id, k.rn) FILTER (k.rn < p.rn AND list_contains(p.dups, k.review_id)) END AS duplicate_of
FROM numbered p LEFT JOIN near_kept me ON me.query_id = p.query_id AND me.review_id = p.review_id
JOIN (SELECT n.* FROM numbered n JOIN near_kept USING (query_id, review_id)) k ON k.query_id = p.query_id
GROUP BY p.query_id, p.review_id, p.rn, p.dups"""
add(
    "exact_dedupe",
    "SELECT query_id, review_id, score FROM exact",
    **pools("hydrated", False),
)
add("near_dedupe", _NEAR, **pools("hydrated", False))
add("near_dedupe_wide", _NEAR, **pools("hydrated_wide", False))


def selection(settings: dedupe.Selection, levels: bool) -> dict[str, str]:
    """Both sweeps of the diverse selection, once per query and level."""
    steps = ", ".join(str(n) for n in settings.levels)
    source = (
        f"""SELECT l.level, n.* FROM numbered n JOIN near_kept USING (query_id, review_id) JOIN (SELECT unnest([{steps}]) AS level) l
ON n.rank <= l.level"""
        if levels
        else "SELECT 0 AS level, * FROM numbered"
    )
    return {
        "staged_pool": source,
        "vector_pairs": f"""SELECT a.review_id AS a, b.review_id AS b FROM (SELECT * FROM review_embeddings WHERE review_id IN (SELECT review_id FROM exact)) a
JOIN (SELECT * FROM review_embeddings WHERE review_id IN (SELECT review_id FROM exact)) b ON a.review_id <> b.review_id
WHERE round(list_cosine_similarity(a.embedding, b.embedding), 9) >= {settings.vector_duplicate}""",
        "vector_repeats": "SELECT a AS review_id, list(b) AS near FROM vector_pairs GROUP BY a",
        "staged": f"""SELECT p.query_id, p.level, p.review_id, p.pattern, list_concat(p.dups, coalesce(v.near, []::BIGINT[])) AS similar,
  CAST(row_number() OVER (PARTITION BY p.query_id, p.level ORDER BY p.score DESC, p.review_id) AS BIGINT) AS pos,
  CAST(count(*) OVER (PARTITION BY p.query_id, p.level, p.pattern) AS DOUBLE) / count(*) OVER (PARTITION BY p.query_id, p.level) >= {settings.dominant_share} AS dominant
FROM staged_pool p LEFT JOIN vector_repeats v USING (review_id)""",
        "first_sweep": f"""SELECT query_id, level, CAST(0 AS BIGINT) AS pos, []::BIGINT[] AS picked, []::VARCHAR[] AS patterns
FROM (SELECT DISTINCT query_id, level FROM staged)
UNION ALL SELECT s.query_id, s.level, p.pos,
  CASE WHEN {{take}} THEN list_append(s.picked, p.review_id) ELSE s.picked END,
  CASE WHEN {{take}} THEN list_append(s.patterns, p.pattern) ELSE s.patterns END
FROM first_sweep s JOIN staged p ON p.query_id = s.query_id AND p.level = s.level AND p.pos = s.pos + 1""".replace(
            "{take}",
            f"""len(s.picked) < {settings.final_k} AND NOT (p.dominant AND len(list_filter(s.patterns, lambda x: x = p.pattern)) >= {settings.max_same_pattern})
      AND NOT list_has_any(s.picked, p.similar)""",
        ),
        "second_sweep": f"""SELECT query_id, level, CAST(0 AS BIGINT) AS pos, arg_max(picked, pos) AS picked FROM first_sweep GROUP BY query_id, level
UNION ALL SELECT s.query_id, s.level, p.pos,
  CASE WHEN len(s.picked) < {settings.final_k} AND NOT list_contains(s.picked, p.review_id) AND NOT list_has_any(s.picked, p.similar)
    THEN list_append(s.picked, p.review_id) ELSE s.picked END
FROM second_sweep s JOIN staged p ON p.query_id = s.query_id AND p.level = s.level AND p.pos = s.pos + 1""",
        "picks": "SELECT query_id, level, arg_max(picked, pos) AS picked FROM second_sweep GROUP BY query_id, level",
    }


_DIVERSE = """SELECT p.query_id, CAST(i AS INT) AS pick, p.picked[i] AS review_id, n.pattern
FROM picks p, unnest(range(1, len(p.picked) + 1)) AS t(i) JOIN numbered n ON n.query_id = p.query_id AND n.review_id = p.picked[i]"""
_DEFAULT = dedupe.Selection()
add("diverse_select", _DIVERSE, **pools("rated", True), **selection(_DEFAULT, False))
add("diverse_select_wide", _DIVERSE, **pools("hydrated_wide", False), **selection(_DEFAULT, False))
add(
    "diverse_select_strict",
    _DIVERSE,
    **pools("hydrated_wide", False),
    **selection(
        dedupe.Selection(vector_duplicate=0.2, dominant_share=0.1, max_same_pattern=1, final_k=40), False
    ),
)


def progressive(settings: dedupe.Selection) -> tuple[str, dict[str, str]]:
    steps = ", ".join(str(n) for n in settings.levels)
    sql = """SELECT r.query_id, CAST(l.level AS INT) AS level, l.full AS stopped_early, CAST(l.distinct_texts AS INT) AS distinct_texts,
  CAST(l.distinct_texts - l.unique_texts AS INT) AS near_duplicates_removed, array_to_string(b.picked, ',') AS selected,
  CAST(len(b.picked) AS INT) AS selected_count, l.dominant AS dominant_patterns, l.distribution
FROM questions r
JOIN last_stage l USING (query_id) JOIN best_stage b USING (query_id)"""
    stages = {
        "all_stages": f"""SELECT q.query_id, s.level, coalesce(k.picked, []::BIGINT[]) AS picked, coalesce(len(k.picked), 0) >= {settings.final_k} AS full,
  (SELECT count(*) FROM numbered n WHERE n.query_id = q.query_id AND n.rank <= s.level) AS distinct_texts,
  (SELECT count(*) FROM staged n WHERE n.query_id = q.query_id AND n.level = s.level) AS unique_texts,
  coalesce((SELECT string_agg(DISTINCT n.pattern, ',' ORDER BY n.pattern) FROM staged n WHERE n.query_id = q.query_id AND n.level = s.level AND n.dominant), '') AS dominant,
  coalesce((SELECT string_agg(pattern || '=' || c, ',' ORDER BY pattern) FROM (SELECT n.query_id, n.level, n.pattern, count(*) AS c FROM staged n GROUP BY ALL) n WHERE n.query_id = q.query_id AND n.level = s.level), '') AS distribution
FROM questions q JOIN (SELECT unnest([{steps}]) AS level) s ON true
LEFT JOIN picks k ON k.query_id = q.query_id AND k.level = s.level""",
        "tried": """SELECT * FROM all_stages a WHERE NOT EXISTS (SELECT 1 FROM all_stages f WHERE f.query_id = a.query_id AND f.full AND f.level < a.level)""",
        "last_stage": "SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level DESC) = 1",
        "best_stage": "SELECT query_id, picked FROM tried QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(picked) DESC, level) = 1",
    }
    return sql, {**selection(settings, True), **stages}


_sql, _ctes = progressive(_DEFAULT)
add("progressive_retrieve", _sql, **pools("rated", True), **_ctes)
_sql, _wide = progressive(
    dedupe.Selection(vector_duplicate=0.12, levels=(5, 20, 60, 150, 5000), final_k=12)
)
add("progressive_retrieve_wide", _sql, **pools("hydrated_wide", False), **_wide)

add(
    "retrieval_steps",
    """SELECT l.query_id, CAST(l.level AS INT) AS level, l.full AS stopped_early,
  (SELECT max(x.threshold) FROM relevant x WHERE x.query_id = l.query_id) AS threshold,
  (SELECT count(*) FROM relevant x WHERE x.query_id = l.query_id AND x.rank <= l.level) AS semantic_candidates,
  (SELECT count(*) FROM hydrated x WHERE x.query_id = l.query_id AND x.rank <= l.level) AS evidence_rows,
  (SELECT count(*) FROM hydrated x WHERE x.query_id = l.query_id AND x.rank <= l.level)
    - (SELECT count(*) FROM intent_hits x WHERE x.query_id = l.query_id AND x.rank <= l.level) AS query_filtered,
  (SELECT count(*) FROM intent_hits x WHERE x.query_id = l.query_id AND x.rank <= l.level) - l.distinct_texts AS exact_duplicates_removed,
  CAST(l.distinct_texts - l.unique_texts AS INT) AS near_duplicates_removed, CAST(len(b.picked) AS INT) AS final_reviews
FROM last_stage l JOIN best_stage b USING (query_id)""",
    **pools("rated", True),
    **_ctes,
)

_EVIDENCE = f"""SELECT q.query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY pick), {text(NO_EVIDENCE)}) AS evidence
FROM questions q LEFT JOIN (
  SELECT b.query_id, i AS pick, concat_ws(chr(10), 'Review ID: ' || h.review_id, 'Rating: ' || coalesce(CAST(h.rating AS VARCHAR), ''),
    'Comment: ' || CASE WHEN length(h.c) > {EVIDENCE_TEXT_LENGTH} THEN substr(h.c, 1, {EVIDENCE_TEXT_LENGTH}) || '...' ELSE h.c END,
    'Sentiment: ' || nullif(h.sentiment_label, ''), 'Sentiment score: ' || CAST(CAST(h.sentiment_score AS DOUBLE) AS VARCHAR),
    'Topic: ' || nullif(h.topic, ''), 'Key issue: ' || nullif(h.key_issue, '')) AS block
  FROM best_stage b, unnest(range(1, len(b.picked) + 1)) AS t(i)
  JOIN (SELECT *, trim(coalesce(comment, ''), {TRIM}) AS c FROM hydrated) h ON h.query_id = b.query_id AND h.review_id = b.picked[i]) e
ON e.query_id = q.query_id GROUP BY q.query_id"""
add("format_evidence", _EVIDENCE, **pools("rated", True), **_ctes)
for _name, _column in RESTAURANT_MEASURES.items():
    _about = {
        "winner": f"""SELECT restaurant_id FROM mart_restaurant_performance WHERE restaurant_name IS NOT NULL
ORDER BY {_column} DESC NULLS LAST, restaurant_id LIMIT 1""",
        "ranked": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS INT) AS rank FROM scored
WHERE review_id IN (SELECT review_id FROM usable JOIN winner USING (restaurant_id)) QUALIFY rank <= 5000""",
        "relevant": """SELECT *, greatest(0.1::DOUBLE, round(max(score) OVER (PARTITION BY query_id) - 0.3::DOUBLE, 9)) AS threshold
FROM ranked QUALIFY score >= threshold""",
    }
    add(f"top_restaurant_evidence_{_name}", _EVIDENCE, **{**pools("rated", True), **_ctes, **_about})
add(
    "format_context",
    """SELECT query_id, string_agg('Review ID: ' || review_id || chr(10) || 'Rating: ' || coalesce(CAST(rating AS VARCHAR), 'None') || ' stars' || chr(10)
  || 'Review: ' || coalesce(comment, 'None') || chr(10) || 'Review date: ' || coalesce(CAST(review_date AS VARCHAR), 'None') || chr(10)
  || 'Similarity score: ' || printf('%.4f', score) || chr(10) || '---' || chr(10), '' ORDER BY rank) AS context
FROM hydrated_wide WHERE rank <= 5 GROUP BY query_id""",
    **stage(),
)
add(
    "mmr_rerank",
    f"""SELECT query_id, CAST(i AS INT) AS pick, picked[i] AS review_id
FROM (SELECT query_id, picked FROM mmr WHERE step = {dedupe.FINAL_K}), unnest(range(1, len(picked) + 1)) AS t(i)""",
    **stage(
        mmr_pool="SELECT r.query_id, r.review_id, r.score, e.embedding FROM ranked r JOIN review_embeddings e USING (review_id) WHERE r.rank <= 40",
        mmr_sim="""SELECT a.query_id, a.review_id AS a, b.review_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS sim
FROM mmr_pool a JOIN mmr_pool b ON a.query_id = b.query_id""",
        mmr=f"""SELECT query_id, 0 AS step, []::BIGINT[] AS picked FROM (SELECT DISTINCT query_id FROM mmr_pool)
UNION ALL SELECT m.query_id, m.step + 1, list_append(m.picked, (
  SELECT p.review_id FROM mmr_pool p WHERE p.query_id = m.query_id AND NOT list_contains(m.picked, p.review_id)
  ORDER BY round(0.7::DOUBLE * p.score - (1::DOUBLE - 0.7::DOUBLE) * coalesce((SELECT max(s.sim) FROM mmr_sim s WHERE s.query_id = p.query_id AND s.a = p.review_id
    AND list_contains(m.picked, s.b)), 0), 9) DESC, p.score DESC, p.review_id LIMIT 1))
FROM mmr m WHERE m.step < {dedupe.FINAL_K}""",
    ),
)

# ------------------------------------------------------------------------ streaming
_COUNTS = ", ".join(
    f"length(lower(comment)) - length(replace(lower(comment), '{c}', '')) AS count_{c}" for c in LETTERS
)
add("stream_embed", f"SELECT review_id, {_COUNTS} FROM usable")
add("stream_ingest", f"SELECT review_id, CAST(review_id // 250 AS BIGINT) AS batch, {_COUNTS} FROM usable")
add(
    "ingest_plan",
    "SELECT CAST(review_id // 250 AS BIGINT) AS batch, count(*) AS rows, review_id // 250 < 2 AS completed FROM usable GROUP BY ALL",
)

# ------------------------------------------------------------------ the whole build
_BUILT = (
    "dim_customer", "dim_food", "dim_restaurant", "fct_orders", "mart_daily_city_revenue", "mart_delivery_sla",
    "mart_restaurant_performance", "mart_food_performance", "mart_customer_performance", "mart_cuisine_performance",
    "mart_payment_performance", "mart_review_insights",
)
SQL["build_all"] = " UNION ALL ".join(
    # The calendar of the build is the fixed range 2024 to 2026.
    ["SELECT 'marts.dim_date' AS table_name, count(*) AS row_count FROM range(DATE '2024-01-01', DATE '2027-01-01', INTERVAL 1 DAY)"]
    + [f"SELECT 'raw.' || table_name AS table_name, row_count FROM ({SQL['table_row_counts']})"]
    + [f"SELECT 'marts.{name}' AS table_name, count(*) AS row_count FROM ({SQL[name]})" for name in _BUILT]
)
SQL["published_build"] = SQL["mart_daily_city_revenue"]
