"""DuckDB statements of enrichment, question rules and evaluation queries."""

from __future__ import annotations

from oracle.base import TRIM, half_up, text, text_list
from oracle.statements import add
from platter.functions.text import SPACE_CLASS
from platter.plans.enrichment import LABELS, REQUIRED_FIELDS
from platter.plans.evaluation import (
    EMPTY_SQL, EXTERNAL_TERMS, FALLBACK_REASON, FALLBACK_ROUTE, FORBIDDEN_SQL, FORBIDDEN_SQL_REASON, NOT_A_QUERY,
    OTHER_CATEGORY, QUESTION_CATEGORIES, ROUTES, SEVERAL_STATEMENTS,
)
from platter.sources.sample import LOG_QUESTIONS, LOG_SQL, MODELS


def pick(values, index: str) -> str:
    return f"({text_list(values)})[CAST(({index}) % {len(values)} AS INT) + 1]"


_FIRST_FIELD = "regexp_replace(items[1], '{}', '{}')"
_VARIANTS = [
    "'[' || array_to_string(items, ', ') || ']'",
    "'```json' || chr(10) || '[' || array_to_string(items, ', ') || ']' || chr(10) || '```'",
    "'Here are the results: [' || array_to_string(items, ', ') || '] Done.'",
    *[
        "'[' || array_to_string(list_concat([" + _FIRST_FIELD.format(a, b) + "], items[2:]), ', ') || ']'"
        for a, b in (
            ('"sentiment_label": "[a-z]+"', '"sentiment_label": "mixed"'),
            ('"sentiment_score": [-0-9.]+', '"sentiment_score": 1.2'),
            ('"topic": "[a-z_ ]+", ', ""),
        )
    ],
    "'[' || array_to_string(items[2:], ', ') || ']'",
    "'[' || array_to_string(list_append(items, " + _FIRST_FIELD.format('"review_id": "[0-9]+"', '"review_id": "-1"') + "), ', ') || ']'",
    "'[' || array_to_string(list_concat([items[1]], items), ', ') || ']'",
    "'not json'",
    "NULL",
    "'[' || array_to_string(list_concat(["
    + _FIRST_FIELD.format('"sentiment_score": [-0-9.]+', '"sentiment_score": "0.5"')
    + "], items[2:]), ', ') || ']'",
]
_N = f"(batch_id + 5 * (priority - 1)) % {len(_VARIANTS)}"
_UNFENCED = rf"""trim(regexp_replace(regexp_replace(trim(raw, {TRIM}), '\A```[^\n]*\n?', ''), '\n?[ \t]*```[^\n]*\z', ''), {TRIM})"""
_LABEL = pick(("positive", "neutral", "negative"), "doc_id * priority")
_SCORE = pick(("0.5", "0.0", "-0.25", "1"), "doc_id * priority")
_TOPIC = pick(("food_quality", " delivery ", "service", "other"), "doc_id * priority")
RESPONSES = {
    "answer_items": f"""SELECT doc_id // 15 AS batch_id, priority, list('{{"review_id": "' || doc_id || '", "sentiment_label": "' || {_LABEL}
  || '", "sentiment_score": ' || {_SCORE} || ', "topic": "' || {_TOPIC} || '", "key_issue": '
  || CASE doc_id % 3 WHEN 0 THEN '" issue ' || (doc_id % 7) || ' "' WHEN 1 THEN '"  "' ELSE 'null' END || '}}' ORDER BY doc_id) AS items
FROM documents, (SELECT unnest([1, 2, 3, 4]) AS priority) GROUP BY ALL""",
    "answers": f"""SELECT batch_id, {pick(MODELS, 'priority - 1')} AS model, priority,
  CASE WHEN {_N} <> 10 THEN 1 + (batch_id * 7 + priority * 3) % 11 END AS seconds,
  CASE {_N} {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(_VARIANTS))} END AS raw FROM answer_items""",
    "requested": "SELECT doc_id // 15 AS batch_id, list(CAST(doc_id AS VARCHAR)) AS want FROM documents GROUP BY ALL",
    "extracted": rf"""SELECT *, {_UNFENCED} AS whole, nullif(regexp_extract({_UNFENCED}, '(?s)\[.*\]', 0), '') AS body FROM answers""",
    "parsed": """SELECT * EXCLUDE (whole, body), CASE WHEN body IS NOT NULL AND json_valid(body) AND json_type(body) = 'ARRAY'
  THEN json_extract(body, '$[*]') END AS objects FROM extracted""",
    "objects_out": f"""SELECT batch_id, model, priority, CAST(pos - 1 AS INT) AS position, objects[pos] AS o,
  {', '.join(f"json_extract_string(objects[pos], '$.{f}') AS {f}" for f in REQUIRED_FIELDS)}
FROM parsed, unnest(range(1, len(objects) + 1)) AS t(pos)""",
    "object_checks": f"""SELECT batch_id, priority, count(*) AS n, count(*) FILTER (NOT list_has_all(json_keys(o), {text_list(REQUIRED_FIELDS)})) AS missing_fields,
  count(*) FILTER (coalesce(sentiment_label NOT IN ({', '.join(text(v) for v in LABELS)}), true)) AS bad_labels,
  count(*) FILTER (coalesce(NOT (TRY_CAST(sentiment_score AS DOUBLE) BETWEEN -1 AND 1), true)) AS bad_scores,
  count(*) FILTER (coalesce(NOT (json_type(o, '$.sentiment_score') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND TRY_CAST(sentiment_score AS DOUBLE) BETWEEN 0 AND 1), true)) AS bad_numbers,
  list(review_id) FILTER (review_id IS NOT NULL) AS ids FROM objects_out GROUP BY batch_id, priority""",
    "checks": """SELECT p.*, coalesce(len(p.objects), 0) AS n, r.want, coalesce(c.ids, []::VARCHAR[]) AS ids, CAST(p.objects IS NULL AS INT) AS bad_json,
  coalesce(c.missing_fields, 0) AS missing_fields, coalesce(c.bad_labels, 0) AS bad_labels, coalesce(c.bad_scores, 0) AS bad_scores,
  coalesce(c.bad_numbers, 0) AS bad_numbers
FROM parsed p JOIN requested r USING (batch_id) LEFT JOIN object_checks c USING (batch_id, priority)""",
    "id_checks": """SELECT *, len(list_filter(list_distinct(ids), lambda i: NOT list_contains(want, i))) AS unexpected_ids,
  len(list_filter(want, lambda i: NOT list_contains(ids, i))) AS missing_ids, len(ids) - len(list_distinct(ids)) AS duplicate_ids, n - len(want) AS count_gap
FROM checks""",
    "verdicts": """SELECT *, bad_json = 0 AND missing_fields = 0 AND bad_labels = 0 AND bad_scores = 0 AND unexpected_ids = 0 AND missing_ids = 0
  AND duplicate_ids = 0 AND count_gap = 0 AS valid FROM id_checks""",
    "chosen": "SELECT * FROM verdicts WHERE valid QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY priority) = 1",
    "clean": f"""SELECT o.review_id, trim(o.sentiment_label, {TRIM}) AS sentiment_label, CAST(o.sentiment_score AS DOUBLE) AS sentiment_score,
  trim(o.topic, {TRIM}) AS topic, nullif(trim(o.key_issue, {TRIM}), '') AS key_issue, TIMESTAMP '2024-07-01 00:00:00' AS processed_at, o.model AS model_used
FROM objects_out o JOIN chosen c USING (batch_id, priority)""",
}


def responses(name: str, sql: str, **extra: str) -> None:
    add(name, sql, **RESPONSES, **extra)


add(
    "unprocessed_reviews",
    """SELECT CAST(review_id AS VARCHAR) AS review_id, rating, comment FROM usable r
WHERE NOT EXISTS (SELECT 1 FROM review_enriched e WHERE e.review_id = CAST(r.review_id AS VARCHAR))""",
)
add(
    "enrichment_run",
    """SELECT CAST(review_id AS VARCHAR) AS review_id, label AS sentiment_label,
  CASE label WHEN 'positive' THEN 0.9 WHEN 'negative' THEN 0.1 ELSE 0.5 END::DOUBLE AS sentiment_score, 'other' AS topic,
  CAST(NULL AS VARCHAR) AS key_issue, TIMESTAMP '2024-07-01 00:00:00' AS processed_at, model AS model_used
FROM run_labels WHERE model IS NOT NULL""",
    run_open="""SELECT review_id, rating, (row_number() OVER (ORDER BY review_id) - 1) // 15 AS batch FROM usable r
WHERE NOT EXISTS (SELECT 1 FROM review_enriched e WHERE e.review_id = CAST(r.review_id AS VARCHAR))""",
    run_models="""SELECT batch, CASE WHEN min(review_id) % 5 <> 0 THEN 'steady' WHEN min(review_id) % 7 <> 0 THEN 'spare' END AS model
FROM run_open GROUP BY batch""",
    run_labels="""SELECT o.review_id, m.model, CASE WHEN m.model = 'spare' THEN 'neutral' WHEN coalesce(nullif(rating, 0), 3) >= 4 THEN 'positive'
  WHEN coalesce(nullif(rating, 0), 3) <= 2 THEN 'negative' ELSE 'neutral' END AS label FROM run_open o JOIN run_models m USING (batch)""",
)
add(
    "stream_enrich",
    """SELECT CAST(review_id AS VARCHAR) AS review_id, label AS sentiment_label,
  CASE label WHEN 'positive' THEN 0.9 WHEN 'negative' THEN 0.1 ELSE 0.5 END::DOUBLE AS sentiment_score, 'other' AS topic,
  CAST(NULL AS VARCHAR) AS key_issue, TIMESTAMP '2024-07-01 00:00:00' AS processed_at, 'plain' AS model_used
FROM (SELECT review_id, CASE WHEN coalesce(nullif(rating, 0), 3) >= 4 THEN 'positive' WHEN coalesce(nullif(rating, 0), 3) <= 2 THEN 'negative'
        ELSE 'neutral' END AS label
      FROM usable r WHERE NOT EXISTS (SELECT 1 FROM review_enriched e WHERE e.review_id = CAST(r.review_id AS VARCHAR)))""",
)
_RUN_TRIES = {
    "run_open": """SELECT review_id, (row_number() OVER (ORDER BY review_id) - 1) // 15 AS batch FROM usable r
WHERE NOT EXISTS (SELECT 1 FROM review_enriched e WHERE e.review_id = CAST(r.review_id AS VARCHAR))""",
    "run_batches": "SELECT '1/' || CAST(batch + 1 AS VARCHAR) AS batch_id, min(review_id) AS i, count(*) AS reviews FROM run_open GROUP BY batch",
    "run_answers": """SELECT batch_id, reviews, model, priority, CAST(attempt AS INT) AS attempt, CASE
    WHEN priority = 1 AND attempt <= 2 AND i % 5 = 0 THEN 'failed'
    WHEN i % 7 = 0 OR (priority = 1 AND attempt = 1 AND i % 3 = 0) THEN 'invalid' ELSE 'success' END AS status
  FROM run_batches, (VALUES ('recovering', 1), ('spare', 2)) m(model, priority), range(1, 5) t(attempt)""",
    "run_tries": """SELECT * EXCLUDE (done) FROM (SELECT *, coalesce(bool_or(status = 'success') OVER (PARTITION BY batch_id
    ORDER BY priority, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM run_answers) WHERE NOT done""",
}
add("enrichment_attempts", "SELECT batch_id, model, attempt, status, CAST(reviews AS INT) AS reviews FROM run_tries", **_RUN_TRIES)
add(
    "enrichment_attempts_used",
    """SELECT batch_id, count(*) AS attempts_used, bool_or(status = 'success') AS success,
  count(*) FILTER (status = 'invalid') AS invalid_attempts, count(*) FILTER (status = 'failed') AS failed_attempts FROM run_tries GROUP BY batch_id""",
    **_RUN_TRIES,
)
add(
    "enrichment_run_log",
    f"""SELECT '2024-07-01 00:00:00' AS run_at, model, attempt, batches_asked, batches_success, batches_invalid, batches_failed, reviews_asked, reviews_answered,
  {half_up('100 * so_far', 'asked', 2)} AS progress_percent
FROM (SELECT *, CAST(sum(reviews_answered) OVER w AS BIGINT) AS so_far, first_value(reviews_asked) OVER w AS asked FROM (
  SELECT model, priority, attempt, count(*) AS batches_asked, count(*) FILTER (status = 'success') AS batches_success,
    count(*) FILTER (status = 'invalid') AS batches_invalid, count(*) FILTER (status = 'failed') AS batches_failed,
    CAST(sum(reviews) AS BIGINT) AS reviews_asked, CAST(coalesce(sum(reviews) FILTER (status = 'success'), 0) AS BIGINT) AS reviews_answered
  FROM run_tries GROUP BY model, priority, attempt) WINDOW w AS (ORDER BY priority, attempt))""",
    **_RUN_TRIES,
)
add(
    "enrich_coverage",
    f"""SELECT *, usable_reviews - enriched_reviews AS open_reviews, {half_up('100 * enriched_reviews', 'usable_reviews', 2)} AS progress_percent
FROM (SELECT count(*) AS usable_reviews, count(*) FILTER (CAST(review_id AS VARCHAR) IN (SELECT review_id FROM review_enriched)) AS enriched_reviews
      FROM usable)""",
)
responses("response_parse", "SELECT batch_id, model, position, " + ", ".join(REQUIRED_FIELDS) + " FROM objects_out")
_COUNTED = "bad_json, missing_fields, bad_labels, bad_scores, unexpected_ids, missing_ids, duplicate_ids, count_gap"
responses("response_validate", f"SELECT batch_id, model, priority, {_COUNTED}, valid FROM verdicts")
responses(
    "response_scorecard",
    """SELECT batch_id, model, priority, CAST(len(want) AS INT) AS expected_count, CASE WHEN is_array THEN n ELSE 0 END AS actual_count,
  json_valid, is_array, count_match, required_fields_valid, sentiment_values_valid, sentiment_scores_valid, review_ids_valid,
  json_valid AND is_array AND count_match AND required_fields_valid AND sentiment_values_valid AND sentiment_scores_valid AND review_ids_valid AS overall_valid,
  concat_ws('|', CASE WHEN NOT json_valid THEN 'json_valid' END, CASE WHEN NOT is_array THEN 'is_array' END,
    CASE WHEN NOT count_match THEN 'count_match' END, CASE WHEN NOT required_fields_valid THEN 'required_fields_valid' END,
    CASE WHEN NOT sentiment_values_valid THEN 'sentiment_values_valid' END, CASE WHEN NOT sentiment_scores_valid THEN 'sentiment_scores_valid' END,
    CASE WHEN NOT review_ids_valid THEN 'review_ids_valid' END) AS errors FROM cards""",
    readable="SELECT batch_id, priority, coalesce(json_valid(whole), false) AS ok FROM extracted",
    cards="""SELECT i.*, ok AS json_valid, ok AS is_array, ok AND count_gap = 0 AS count_match, ok AND missing_fields = 0 AS required_fields_valid,
  ok AND bad_labels = 0 AS sentiment_values_valid, ok AND bad_numbers = 0 AS sentiment_scores_valid,
  ok AND unexpected_ids = 0 AND missing_ids = 0 AS review_ids_valid FROM id_checks i JOIN readable USING (batch_id, priority)""",
)
responses(
    "response_validate_strict",
    """SELECT v.batch_id, v.model, v.priority, v.valid AND coalesce(t.bad_topics, 0) = 0 AS valid
FROM verdicts v LEFT JOIN topic_checks t USING (batch_id, priority)""",
    topic_checks="""SELECT batch_id, priority, count(*) FILTER (coalesce(topic NOT IN
  ('delivery', 'food_quality', 'price', 'service', 'packaging', 'other'), true)) AS bad_topics FROM objects_out GROUP BY batch_id, priority""",
)
responses("first_valid_model", "SELECT batch_id, model, priority FROM chosen")
responses(
    "attempts_used",
    """SELECT batch_id, count(*) AS attempts_used, bool_or(valid) AS success,
  count(*) FILTER (NOT valid AND raw IS NOT NULL) AS invalid_attempts, count(*) FILTER (raw IS NULL) AS failed_attempts
FROM (SELECT *, min(priority) FILTER (valid) OVER (PARTITION BY batch_id) AS first_valid FROM verdicts)
WHERE first_valid IS NULL OR priority <= first_valid GROUP BY batch_id""",
)
responses(
    "model_run_stats",
    f"""SELECT *, {half_up('total_seconds', 'reviews_successful', 4)} AS seconds_per_review FROM (
  SELECT model, count(*) FILTER (valid) AS successful_batches, count(*) FILTER (NOT valid) AS failed_batches,
    CAST(sum(CASE WHEN valid THEN n ELSE 0 END) AS BIGINT) AS reviews_successful, CAST(sum(seconds) AS BIGINT) AS total_seconds FROM verdicts GROUP BY model)""",
)
responses(
    "response_time_summary",
    f"""SELECT count(*) AS responses, count(seconds) AS timed, {half_up('sum(seconds)', 'count(seconds)', 4)} AS avg_seconds,
  min(seconds) AS fastest_seconds, max(seconds) AS slowest_seconds FROM answers""",
)
_SIDE = "SELECT o.* FROM objects_out o JOIN verdicts v USING (batch_id, priority) WHERE v.valid AND o.model = {}"
_COMPARED = {
    "left_items": _SIDE.format(text(MODELS[0])),
    "right_items": _SIDE.format(text(MODELS[2])),
    "compared": """SELECT a.review_id, a.sentiment_label AS left_sentiment_label, a.sentiment_score AS left_sentiment_score, a.topic AS left_topic,
  a.key_issue AS left_key_issue, b.sentiment_label AS right_sentiment_label, b.sentiment_score AS right_sentiment_score, b.topic AS right_topic,
  b.key_issue AS right_key_issue, a.sentiment_label IS NOT DISTINCT FROM b.sentiment_label AS sentiment_match,
  a.topic IS NOT DISTINCT FROM b.topic AS topic_match, abs(CAST(a.sentiment_score AS DOUBLE) - CAST(b.sentiment_score AS DOUBLE)) AS score_difference
FROM left_items a JOIN right_items b USING (review_id)""",
}
responses("model_compare", "SELECT * FROM compared", **_COMPARED)
responses(
    "model_agreement",
    f"""SELECT *, coalesce({half_up('100 * sentiment_matches', 'reviews_compared', 4)}, 0) AS sentiment_agreement_percent,
  coalesce({half_up('100 * topic_matches', 'reviews_compared', 4)}, 0) AS topic_agreement_percent
FROM (SELECT count(*) AS reviews_compared, count(*) FILTER (sentiment_match) AS sentiment_matches, count(*) FILTER (topic_match) AS topic_matches
      FROM compared)""",
    **_COMPARED,
)
responses("enrich_clean", "SELECT * FROM clean")
responses(
    "enrich_append",
    """SELECT review_id, sentiment_label, score_100 / 100.0 AS sentiment_score, topic, key_issue, processed_at, model_used FROM review_enriched
UNION ALL SELECT * FROM clean WHERE review_id NOT IN (SELECT review_id FROM review_enriched)""",
)

# ------------------------------------------------------------- questions and routes
FULL_LOG = {
    "full_log": f"""SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 3 = 0
  THEN concat_ws(' ', {pick(LOG_QUESTIONS, 'conv_id * 7 + turn')}, question) ELSE question END AS question FROM question_log""",
}
_CATEGORY = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(question), {text(w)})" for w in words) + f" THEN {text(name)}"
    for name, words in QUESTION_CATEGORIES.items()
)
add("question_category", f"SELECT conv_id, turn, CASE {_CATEGORY} ELSE {text(OTHER_CATEGORY)} END AS category FROM full_log", **FULL_LOG)
add(
    "domain_flag",
    f"""SELECT conv_id, turn, matched_terms, matched_terms <> '' AS external FROM (SELECT conv_id, turn,
  array_to_string(list_filter({text_list(EXTERNAL_TERMS)}, lambda t: contains(q, t)), '|') AS matched_terms
FROM (SELECT *, regexp_replace(lower(trim(question, {TRIM})), '[{SPACE_CLASS}]+', ' ', 'g') AS q FROM full_log))""",
    **FULL_LOG,
)
_FORBIDDEN = " ".join(
    f"WHEN regexp_matches(s, '(?i){p}') THEN {text(FORBIDDEN_SQL_REASON + p)}" for p in FORBIDDEN_SQL
)
add(
    "sql_audit",
    rf"""SELECT conv_id, turn, sql, reason, reason IS NULL AS safe FROM (SELECT *, CASE WHEN coalesce(sql, '') = '' THEN {text(EMPTY_SQL)}
  WHEN NOT regexp_matches(s, '(?i)\A(SELECT|WITH)\b') THEN {text(NOT_A_QUERY)} WHEN contains(s, ';') THEN {text(SEVERAL_STATEMENTS)} {_FORBIDDEN} END AS reason
FROM (SELECT conv_id, turn, sql, trim(sql, {TRIM}) AS s
      FROM (SELECT conv_id, turn, CASE WHEN base = '' THEN '' ELSE base || ' -- ' || question END AS sql
            FROM (SELECT *, {pick(LOG_SQL, 'conv_id * 5 + turn')} AS base FROM question_log))))""",
)
_ROUTED = ", ".join(text(r) for r in ROUTES)
add(
    "route_validate",
    f"""SELECT conv_id, turn, CASE WHEN n = 0 THEN 'sql' WHEN n = 1 THEN 'rag' WHEN n = 2 THEN 'hybrid' ELSE {text(FALLBACK_ROUTE)} END AS route,
  CASE WHEN n = 0 THEN 0.9::DOUBLE WHEN n = 1 THEN 0.5::DOUBLE WHEN n = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN n > 2 THEN {text(FALLBACK_REASON)} ELSE trim(question, {TRIM}) END AS reason, n > 2 AS fallback
FROM (SELECT conv_id, turn, question, (conv_id * 3 + turn) % 11 AS n FROM question_log)""",
)
CASES = {
    "route_cases": f"""SELECT conv_id, turn, {pick(ROUTES, 'conv_id')} AS expected,
  CASE WHEN length(question) % 7 <> 0 THEN {pick(ROUTES, 'conv_id + CASE WHEN length(question) % 5 = 0 THEN 1 ELSE 0 END')} END AS actual,
  1 + length(question) % 9 AS seconds FROM question_log""",
}
add(
    "route_confusion",
    "SELECT expected, "
    + ", ".join(f"count(*) FILTER (actual = '{r}') AS as_{r}" for r in ROUTES)
    + ", count(*) FILTER (actual IS NULL) AS as_none FROM route_cases GROUP BY expected",
    **CASES,
)
add(
    "route_accuracy",
    f"""SELECT *, {half_up('100 * passed', 'cases', 2)} AS accuracy_percent, {half_up('total_seconds', 'cases', 4)} AS avg_seconds
FROM (SELECT count(*) AS cases, count(*) FILTER (expected = actual) AS passed, count(*) FILTER (expected IS DISTINCT FROM actual) AS failed,
  CAST(sum(seconds) AS BIGINT) AS total_seconds FROM route_cases)""",
    **CASES,
)
