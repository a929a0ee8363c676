"""Batching, enrichment runs, index builds, streams and loads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.operators import batching, ranking
from platter.plans import enrichment, evaluation, index
from platter.schemas import REVIEW_ENRICHED
from platter.sources import tables
from platter.streaming import jobs

REVIEWS = "review_id bigint, rating bigint, comment string"


def make_reviews(spark, n, start=0):
    return spark.createDataFrame([(i, 1 + i % 5, f"text {i}") for i in range(start, start + n)], REVIEWS)


# ------------------------------------------------------------------------ batching
def test_numbered_is_exact(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = ranking.numbered(df, ["g", "k"], "position").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000))
    assert [(r["g"], r["k"]) for r in got] == sorted((r["g"], r["k"]) for r in got)


def test_batches_are_full_but_the_last(spark):
    batched = batching.with_batch(make_reviews(spark, 100), "review_id", 15, workers=3)
    payloads = batching.request_payloads(batched).orderBy("worker", "batch_no").collect()
    assert [r["reviews"] for r in payloads] == [15, 15, 4, 15, 15, 3, 15, 15, 3]
    assert payloads[0]["review_ids"] == list(range(0, 45, 3))
    assert json.loads(payloads[0]["payload"])[1] == {"review_id": 3, "rating": 4, "comment": "text 3"}


def test_first_n_as_text(spark):
    df = make_reviews(spark, 120)
    assert [r["review_id"] for r in batching.first_n(df, 4, as_text=True).collect()] == [0, 1, 10, 100]
    assert [r["review_id"] for r in batching.first_n(df, 3).collect()] == [0, 1, 2]


def test_keyset_pages_cover_everything(spark):
    df, last, seen = make_reviews(spark, 23), None, []
    while page := batching.keyset_page(df, "review_id", last, 10).collect():
        seen += [r["review_id"] for r in page]
        last = seen[-1]
    assert seen == list(range(23))


def test_stratified_sample(spark):
    df = make_reviews(spark, 500)
    drawn = batching.stratified_sample(df, seed=3)
    counts = {r["stratum"]: r["count"] for r in drawn.groupBy("stratum").count().collect()}
    assert counts == batching.STRATA
    assert drawn.filter("stratum = 'positive' AND rating < 4").count() == 0
    again = batching.stratified_sample(df.repartition(9), seed=3)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    other = batching.stratified_sample(df, seed=4)
    assert sorted(map(tuple, drawn.collect())) != sorted(map(tuple, other.collect()))


# ---------------------------------------------------------------------- validation
def item(i, label="positive", score=0.5, **changes):
    return {"review_id": str(i), "sentiment_label": label, "sentiment_score": score, "topic": "food", "key_issue": None, **changes}


GOOD = [item(1), item(2)]
NO_TOPIC = [{k: v for k, v in item(1).items() if k != "topic"}, item(2)]
CASES = {
    "plain": (json.dumps(GOOD), True, True),
    "fenced": ("```json\n" + json.dumps(GOOD) + "\n```", True, True),
    "prose": ("Sure: " + json.dumps(GOOD) + " bye", True, False),
    "label": (json.dumps([item(1, "mixed"), item(2)]), False, False),
    "score": (json.dumps([item(1, score=1.2), item(2)]), False, False),
    "negative score": (json.dumps([item(1, score=-0.5), item(2)]), True, False),
    "text score": (json.dumps([item(1, score="0.5"), item(2)]), True, False),
    "bad score": (json.dumps([item(1, score="high"), item(2)]), False, False),
    "missing field": (json.dumps(NO_TOPIC), False, False),
    "missing id": (json.dumps([item(1)]), False, False),
    "extra id": (json.dumps(GOOD + [item(3)]), False, False),
    "other id": (json.dumps([item(1), item(3)]), False, False),
    "duplicate id": (json.dumps([item(1), item(1)]), False, False),
    "not objects": ("[1, 2]", False, False),
    "object": (json.dumps(item(1)), False, False),
    "not json": ("nope", False, False),
    "empty list": ("[]", False, False),
    "empty": ("", False, False),
    "null": (None, False, False),
}


def test_validation_and_scorecard(spark):
    names = list(CASES)
    responses = spark.createDataFrame([(n, "m", 1, CASES[n][0]) for n in names], "batch_id string, model string, priority int, raw string")
    batches = spark.createDataFrame([(n, [1, 2]) for n in names], "batch_id string, review_ids array<bigint>")
    checked = enrichment.response_validate(enrichment.response_parse(responses), batches)
    assert {r["batch_id"]: r["valid"] for r in checked.collect()} == {n: CASES[n][1] for n in names}
    cards = {r["batch_id"]: r for r in enrichment.response_scorecard(responses, batches).collect()}
    assert {n: cards[n]["overall_valid"] for n in names} == {n: CASES[n][2] for n in names}
    assert cards["object"]["json_valid"] and not cards["object"]["is_array"]
    assert cards["not objects"]["count_match"] and not cards["not objects"]["required_fields_valid"]
    assert cards["text score"]["errors"] == "sentiment_scores_valid"


def test_strict_topics(spark):
    responses = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", json.dumps([item(1, topic="price"), item(2, topic="other")]))],
                                      "batch_id string, raw string")
    batches = spark.createDataFrame([("a", [1, 2]), ("b", [1, 2])], "batch_id string, review_ids array<bigint>")
    checked = enrichment.response_validate(enrichment.response_parse(responses), batches, topics=enrichment.TOPICS)
    assert {r["batch_id"]: r["valid"] for r in checked.collect()} == {"a": False, "b": True}


def answer(payload, label):
    return json.dumps([
        {"review_id": str(r["review_id"]), "sentiment_label": label, "sentiment_score": 0.5, "topic": " food ", "key_issue": " "}
        for r in json.loads(payload)
    ])


def first_model(payloads):  # answers only batches whose first id is even
    return [answer(p, "positive") if json.loads(p)[0]["review_id"] % 2 == 0 else "sorry" for p in payloads]


def second_model(payloads):  # refuses the batch that holds review 40
    return ["sorry" if '"review_id":40,' in p else answer(p, "negative") for p in payloads]


def broken_model(payloads):
    raise RuntimeError("service down")


def test_enrichment_run_is_incremental(spark, tmp_path):
    path = str(tmp_path / "enriched")
    stored = spark.createDataFrame([("0", "neutral", 0.0, "t", None, None, "old")], REVIEW_ENRICHED)
    tables.replace_table(stored, path)
    reviews = make_reviews(spark, 50).unionByName(spark.createDataFrame([(100, 1, "  "), (101, 1, None)], REVIEWS))
    models = {"down": broken_model, "first": first_model, "second": second_model}

    one = enrichment.run_enrichment(spark, reviews, path, models, "2024-07-01 00:00:00")
    assert one == {"reviews_selected": 49, "batches": 4, "batches_completed": 3, "batches_failed": 1, "rows_written": 34}
    table = spark.read.schema(REVIEW_ENRICHED).parquet(path)
    used = {r["model_used"]: r["count"] for r in table.groupBy("model_used").count().collect()}
    assert used == {"old": 1, "first": 19, "second": 15}
    assert table.filter("model_used <> 'old' AND (topic <> 'food' OR key_issue IS NOT NULL)").count() == 0

    two = enrichment.run_enrichment(spark, reviews, path, models, "2024-07-02 00:00:00")
    assert (two["reviews_selected"], two["batches_failed"], two["rows_written"]) == (15, 1, 0)
    three = enrichment.run_enrichment(spark, reviews, path, {"first": second_model, "last": lambda ps: [answer(p, "neutral") for p in ps]}, "2024-07-03 00:00:00")
    assert (three["rows_written"], three["batches_failed"]) == (15, 0)
    four = enrichment.run_enrichment(spark, reviews, path, models, "2024-07-04 00:00:00")
    assert (four["reviews_selected"], four["batches"], four["rows_written"]) == (0, 0, 0)
    assert spark.read.parquet(path).select("review_id").distinct().count() == 50


def test_agreement_of_nothing(spark):
    empty = spark.createDataFrame([], "review_id string, sentiment_label string, sentiment_score string, topic string, key_issue string")
    row = enrichment.model_agreement(enrichment.model_compare(empty, empty)).first()
    assert row["reviews_compared"] == 0 and row["sentiment_agreement_percent"] == 0


# ----------------------------------------------------------------------- evaluation
@pytest.mark.parametrize(
    "sql, reason",
    [
        ("SELECT 1", None), (" with a as (select 1) select * from a", None), ("SELECT 1; SELECT 2", evaluation.SEVERAL_STATEMENTS),
        ("DROP TABLE x", evaluation.NOT_A_QUERY), ("select * from t where x = 1 delete", evaluation.FORBIDDEN_SQL_REASON + r"\bDELETE\b"),
        ("", evaluation.EMPTY_SQL), (None, evaluation.EMPTY_SQL), ("   ", evaluation.NOT_A_QUERY), ("SELECTED", evaluation.NOT_A_QUERY),
        ("SELECT 1 EXPORT  DATA", evaluation.FORBIDDEN_SQL_REASON + r"\bEXPORT\s+DATA\b"), ("select created_at from t", None),
        ("select 1 grant drop", evaluation.FORBIDDEN_SQL_REASON + r"\bDROP\b"),
    ],
)
def test_sql_audit(spark, sql, reason):
    row = evaluation.sql_audit(spark.createDataFrame([(sql,)], "sql string")).first()
    assert (row["reason"], row["safe"]) == (reason, reason is None)


@pytest.mark.parametrize(
    "question, category",
    [("Top topics of customer complaints about delivery", "Review analytics"), ("p90 by restaurant", "Delivery analytics"),
     ("best cuisine by user", "Restaurant analytics"), ("average order", "Customer analytics"),  # 'age' is part of 'average'
     ("GMV by city", "Order/revenue analytics"), ("hello", "General analytics")],
)
def test_question_category(spark, question, category):
    assert evaluation.question_category(spark.createDataFrame([(question,)], "question string")).first()["category"] == category


def test_route_validation(spark):
    answers = ['{"route": " SQL", "confidence": "1", "reason": "x"}', '{"route": "sql", "confidence": 1.01, "reason": "x"}',
               '{"route": "sql", "confidence": null, "reason": "x"}', "[]", None]
    got = evaluation.route_validate(spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, response string")).orderBy("i").collect()
    assert [r["fallback"] for r in got] == [False, True, True, True, True]
    assert (got[0]["route"], got[0]["confidence"]) == ("sql", 1.0) and (got[1]["route"], got[1]["confidence"]) == ("sql", 0.0)


# ---------------------------------------------------------------------------- index
def test_index_build_refuses_broken_vectors(spark, tmp_path):
    good = [(1, [3.0, 4.0], 0), (2, [1.0, 0.0], 0), (1, [0.0, 2.0], 1)]
    schema = "review_id bigint, embedding array<float>, batch int"
    path = str(tmp_path / "index")
    report = index.build_index(spark, spark.createDataFrame(good, schema), ["batch"], 2, path).first()
    assert (report["source_reviews_loaded"], report["duplicates_removed"], report["final_reviews"], report["dimension_ok"]) == (3, 1, 2, True)
    kept = {r["review_id"]: r["embedding"] for r in spark.read.parquet(path).collect()}
    assert kept[1] == pytest.approx([0.6, 0.8])
    assert all(index.index_validation(spark.read.parquet(path), 2, 2).first())
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0], None):
        with pytest.raises(ValueError, match="broken embeddings"):
            index.build_index(spark, spark.createDataFrame(good + [(9, bad, 0)], schema), ["batch"], 2, str(tmp_path / "bad"))


def test_upsert_twice_changes_nothing(spark, rows):
    schema = "review_id bigint, embedding array<float>, version int"
    current = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], schema)
    incoming = spark.createDataFrame([(2, [9.0], 1), (3, [3.0], 1)], schema)
    once = index.vector_upsert(current, incoming)
    assert rows(once) == rows(index.vector_upsert(once, incoming))
    assert {r["review_id"]: r["embedding"] for r in once.collect()} == {1: [1.0], 2: [9.0], 3: [3.0]}


UPSERT = "review_id bigint, embedding array<float>, version int"


def _files(root):
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("part-*.parquet")}


def test_upsert_of_one_id_rewrites_one_bucket(spark, rows, tmp_path):
    root = tmp_path / "vectors"
    start = spark.createDataFrame([(i, [float(i)], 0) for i in range(300)], UPSERT)
    index.publish_upsert(spark, str(root), start, buckets=16)
    entries = {e["bucket"]: e["path"] for e in index._current_manifest(spark, str(root))[1]}
    before = _files(root / "data")
    after = index.publish_upsert(spark, str(root), spark.createDataFrame([(7, [70.0], 1)], UPSERT))
    changed = {e["bucket"]: e["path"] for e in index._current_manifest(spark, str(root))[1]}
    assert len(entries) == 16 and sum(changed[b] != entries[b] for b in entries) == 1
    assert before.items() <= _files(root / "data").items()
    want = sorted(((i, [70.0] if i == 7 else [float(i)], int(i == 7)) for i in range(300)), key=repr)
    assert rows(after) == want
    # Older versions and the same rows again change nothing.
    again = index.publish_upsert(spark, str(root), spark.createDataFrame([(7, [1.0], 0), (7, [70.0], 1), (None, [5.0], 0)], UPSERT))
    assert rows(again.filter("review_id IS NOT NULL")) == want and again.count() == 301
    assert rows(index.publish_upsert(spark, str(root), start.limit(0))) == rows(again)


def test_killed_upsert_leaves_the_old_table(spark, rows, tmp_path, monkeypatch):
    root = str(tmp_path / "vectors")
    index.publish_upsert(spark, root, spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], UPSERT), mark=3)
    with monkeypatch.context() as m:
        m.setattr(index, "MANIFEST_SCHEMA", "broken")
        with pytest.raises(Exception):
            index.publish_upsert(spark, root, spark.createDataFrame([(1, [9.0], 1)], UPSERT), mark=4)
    assert rows(index.current_vectors(spark, root)) == [(1, [1.0], 0), (2, [2.0], 0)] and index.published_mark(spark, root) == 3
    (tmp_path / "vectors" / "manifests" / "0000000001").mkdir()  # a manifest without its success marker
    assert index.published_mark(spark, root) == 3
    index.publish_upsert(spark, root, spark.createDataFrame([(1, [9.0], 1)], UPSERT))
    assert rows(index.current_vectors(spark, root)) == [(1, [9.0], 1), (2, [2.0], 0)] and index.published_mark(spark, root) == 3


# ------------------------------------------------------------------------- streaming
def lengths(texts):
    return np.array([[len(t), 1.0] for t in texts])


def test_stream_embed_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = make_reviews(spark, 30).unionByName(spark.createDataFrame([(900, 1, " "), (901, 1, None)], REVIEWS))
    tables.append_table(first.repartition(3), source)

    def run(embed=lengths):
        jobs.stream_embed(spark, source, first.schema, out, mark, embed, 2, files_per_batch=1)
        return spark.read.parquet(out)

    assert run().count() == 30
    assert run().count() == 30
    tables.append_table(make_reviews(spark, 12, start=30).coalesce(1), source)
    with pytest.raises(Exception):
        run(lambda texts: lengths(texts)[:, :1])  # wrong dimension: nothing of the file is committed
    assert spark.read.parquet(out).count() == 30
    table = run()
    assert table.count() == 42 and table.select("review_id").distinct().count() == 42
    assert table.filter("review_id = 41").first()["embedding"] == [7.0, 1.0]


def test_stream_ingest_takes_small_files_together(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "review_id bigint, comment string, batch int"
    rows = spark.createDataFrame([(i, "a" * i, i % 6) for i in range(1, 25)], schema).coalesce(1)
    rows.write.partitionBy("batch").parquet(source)
    for limit, arrivals in ((1 << 20, 1), (1, 6)):
        root = str(tmp_path / f"root{limit}")
        points = jobs.stream_ingest(spark, source, rows.schema, root, lengths, 2, "reviews", "m", bytes_per_batch=limit)
        assert {r["review_id"]: r["embedding"][0] for r in points.collect()} == {i: float(i) for i in range(1, 25)}
        assert len([n for n in tables.names(spark, f"{root}/points") if n.startswith("arrival=")]) == arrivals


def test_stream_ingest(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = "review_id bigint, comment string, batch int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy("batch").parquet(source)

    def run(model="m", embed=lengths):
        found = spark.createDataFrame([], schema).schema
        return jobs.stream_ingest(spark, source, found, root, embed, 2, "reviews", model)

    arrive([(1, "a", 1), (2, "bb", 1)])
    assert run().count() == 2
    arrive([(2, "bbbb", 2), (3, "c", 2)])
    points = {r["review_id"]: r["embedding"][0] for r in run().collect()}
    assert points == {1: 1.0, 2: 4.0, 3: 1.0}  # the id that came again has its new vector
    with pytest.raises(ValueError, match="progress belongs to"):
        run(model="other")
    arrive([(4, "d", 3), (4, "e", 3)])
    with pytest.raises(ValueError, match="batch refused"):
        run()
    plan = jobs.ingest_plan(spark.read.schema(schema).parquet(source), jobs.completed_batches(spark, f"{root}/points"))
    assert {r["batch"]: (r["rows"], r["completed"]) for r in plan.collect()} == {1: (2, True), 2: (2, True), 3: (2, False)}


def test_second_ingest_reads_only_new_arrivals(spark, rows, tmp_path, monkeypatch):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = "review_id bigint, comment string, batch int"
    found = spark.createDataFrame([], schema).schema

    def run(new):
        spark.createDataFrame(new, schema).write.mode("append").partitionBy("batch").parquet(source)
        return jobs.stream_ingest(spark, source, found, root, lengths, 2, "reviews", "m")

    run([(1, "a", 1), (2, "bb", 1)])
    # The first arrival is merged: what its folder holds now is not looked at again.
    other = spark.createDataFrame([(1, 1, [99.0, 1.0])], "batch int, review_id bigint, embedding array<float>")
    other.write.mode("overwrite").parquet(f"{root}/points/arrival=0")
    kept = index.publish_upsert

    def killed(*args, **kwargs):
        raise RuntimeError("killed")

    monkeypatch.setattr(jobs, "publish_upsert", killed)
    with pytest.raises(RuntimeError, match="killed"):
        run([(2, "bbbb", 2)])
    monkeypatch.setattr(jobs, "publish_upsert", kept)
    points = {r["review_id"]: r["embedding"][0] for r in run([(3, "c", 3)]).collect()}
    assert points == {1: 1.0, 2: 4.0, 3: 1.0}
    assert {r["review_id"] for r in jobs.compact_points(spark, root).collect()} == {1, 2, 3}


def test_late_file_of_a_finished_batch_is_checked(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    schema = "review_id bigint, comment string, batch int"
    found = spark.createDataFrame([], schema).schema

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").partitionBy("batch").parquet(source)

    arrive([(1, "a", 1)])
    assert jobs.stream_ingest(spark, source, found, root, lengths, 2, "reviews", "m").count() == 1
    arrive([(None, "x", 1), (2, " ", 1)])
    with pytest.raises(ValueError, match="batch refused"):
        jobs.stream_ingest(spark, source, found, root, lengths, 2, "reviews", "m")
    assert spark.read.parquet(f"{root}/points").count() == 1


def better_at_the_second_try(payloads, attempt):
    """Invalid first, then valid; ids of 40 and more fail twice before, ids of 60 and more stay invalid."""
    first = json.loads(payloads[0])[0]["review_id"]
    if first >= 40 and attempt <= 2:
        raise RuntimeError("overloaded")
    return ["sorry"] if first >= 60 or attempt == 1 else [answer(p, "positive") for p in payloads]


def test_invalid_answers_are_tried_again(spark, tmp_path):
    reviews = spark.createDataFrame([(i, "5", f"text {i}") for i in range(10, 85)], "review_id bigint, rating string, comment string")
    path, log = str(tmp_path / "enriched"), str(tmp_path / "log")
    spark.createDataFrame([], REVIEW_ENRICHED).write.parquet(path)
    summary = enrichment.run_enrichment(
        spark, reviews, path, {"m": better_at_the_second_try, "last": lambda ps: [answer(p, "neutral") for p in ps]}, "2024-07-01 00:00:00", log_path=log
    )
    assert summary["batches_failed"] == 0 and summary["rows_written"] == 75
    tries = spark.read.schema(enrichment.ATTEMPT_SCHEMA).parquet(log)
    told = {}
    for r in tries.orderBy("priority", "attempt").collect():
        told.setdefault(r["batch_id"], []).append((r["model"], r["attempt"], r["status"]))
    shapes = sorted(map(tuple, told.values()))
    good = (("m", 1, "invalid"), ("m", 2, "success"))
    late = (("m", 1, "failed"), ("m", 2, "failed"), ("m", 3, "success"))
    never = (("m", 1, "failed"), ("m", 2, "failed"), ("m", 3, "invalid"), ("m", 4, "invalid"), ("last", 1, "success"))
    assert shapes == sorted([good, good, late, late, never])
    used = sorted(r["attempts_used"] for r in enrichment.attempts_used(tries).collect())
    assert used == [2, 2, 3, 3, 5]
    log_rows = enrichment.run_log(tries).orderBy("model", "attempt").collect()
    assert [(r["model"], r["attempt"], r["batches_asked"], r["batches_success"]) for r in log_rows] == [
        ("last", 1, 1, 1), ("m", 1, 5, 0), ("m", 2, 5, 2), ("m", 3, 3, 2), ("m", 4, 1, 0)
    ]
    assert float(log_rows[0]["progress_percent"]) == 100


def failing_on_forty(payloads):
    if '"review_id":40,' in payloads[0]:
        raise RuntimeError("bad request")
    return [answer(p, "positive") for p in payloads]


def test_one_bad_request_costs_no_other(spark):
    batches = spark.createDataFrame(
        [(str(i), json.dumps([{"review_id": i}], separators=(",", ":")).replace("}", ',"x":1}')) for i in range(30, 50)], "batch_id string, payload string"
    ).coalesce(1)
    got = {r["batch_id"]: r for r in enrichment.call_model(batches, "m", failing_on_forty, attempts=3).collect()}
    assert len(got) == 20 and got["40"]["raw"] is None and got["40"]["attempts"] == 3 and "bad request" in got["40"]["error"]
    assert all(r["raw"] and r["attempts"] == 1 and r["error"] is None for i, r in got.items() if i != "40")


def test_ingest_violations(spark):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, "b"), (2, None, "a"), (2, 3, None), (2, 4, " "), (2, 5, "x"), (2, 5, "y")],
        "batch int, review_id bigint, comment string",
    )
    got = {r["batch"]: r for r in index.ingest_violations(df).collect()}
    assert got[1]["accepted"] and not got[2]["accepted"]
    assert tuple(got[2][c] for c in ("rows", "null_ids", "duplicate_ids", "null_comments", "blank_comments")) == (5, 1, 1, 1, 1)


# ---------------------------------------------------------------------------- loads
def test_csv_text_survives(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, "two\nlines"), (3, "  padded "), (4, None), (5, "back\\slash")], "i int, t string")
    tables.write_csv(df, str(tmp_path / "csv"))
    loaded = tables.load_csv(spark, str(tmp_path / "csv"), str(tmp_path / "table"), df.schema, multi_line=True)
    assert rows(loaded) == rows(df)


def test_menu_files_are_loaded_once(spark, tmp_path):
    csv, out, mark = (str(tmp_path / n) for n in ("csv", "out", "mark"))
    schema = "menu_id string, price string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").csv(csv, header=True)

    arrive([("a", "1.5"), ("b", "n/a")])
    assert tables.append_csv_once(spark, csv, out, mark, schema).count() == 2
    arrive([("c", "2")])
    loaded = tables.append_csv_once(spark, csv, out, mark, schema)
    assert {r["menu_id"]: r["price"] for r in loaded.collect()} == {"a": 1.5, "b": None, "c": 2.0}


def test_embedding_batches_have_bounded_files(spark, tmp_path):
    path = str(tmp_path / "batches")
    df = make_reviews(spark, 50).withColumn("embedding", F.array(F.lit(1.0)))
    tables.write_embedding_batches(df.coalesce(1), path, rows_per_file=20)
    batches = tables.read_embedding_batches(spark, path)
    assert sorted(r["count"] for r in batches.groupBy("batch_file").count().collect()) == [10, 20, 20]
    assert batches.agg(F.max("batch_position")).first()[0] == 19
    assert tables.embedding_batch_scan(batches).columns == ["review_id", "comment"]
