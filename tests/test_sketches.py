"""Sketches against exact figures and against each other, and enrichment as a stream of several shards."""

import datetime as dt
import random

import pytest

from platter.plans import sketches
from platter.schemas import REVIEW_ENRICHED
from platter.sources import sample, tables
from platter.streaming import jobs

FACT = "order_date date, cuisine string, city string, customer_id bigint, restaurant_id bigint, is_delivered boolean, delivery_time_min bigint"


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(5)
    day = dt.date(2024, 1, 30)
    rows = [
        (day + dt.timedelta(rng.randrange(4)), rng.choice(["a", "b", None]), rng.choice("xy"), rng.randrange(3000), rng.randrange(20),
         rng.random() < 0.8, rng.choice([None, *range(10, 90)]))
        for _ in range(12000)
    ]
    rows.append((day, "none timed", "x", None, 1, False, 30))
    return spark.createDataFrame(rows, FACT)


def test_roll_up_is_within_its_bounds(fact):
    daily = sketches.daily_sketches(fact, ["cuisine", "city"])
    for period in ("month", "year"):
        checked = sketches.roll_up_check(fact, sketches.roll_up(daily, period, ["cuisine"]), period, ["cuisine"]).collect()
        assert len(checked) == (7 if period == "month" else 4)
        for r in checked:
            assert r["customers_within"] and r["restaurants_within"] and r["p50_within"] and r["p90_within"], r
    lone = sketches.roll_up(daily, "year", ["cuisine"]).filter("cuisine = 'none timed'").first()
    assert (lone["orders"], lone["customers"], lone["restaurants"], lone["timed_orders"], lone["p50"]) == (1, 0, 1, 0, None)


def test_steps_of_a_roll_up_do_not_matter(fact):
    daily = sketches.daily_sketches(fact, ["cuisine", "city"])
    direct = sketches.daily_sketches(fact, ["cuisine"])
    by_steps = sketches.merge_sketches(daily, ["order_date", "cuisine"])
    names = ["period", "cuisine", "orders", "customers", "restaurants", "timed_orders"]
    got, want = (
        sorted(map(str, sketches.roll_up(table, "year", ["cuisine"]).select(*names).collect())) for table in (by_steps, direct)
    )
    assert got == want


def test_a_wrong_estimate_is_told(fact):
    rolled = sketches.roll_up(sketches.daily_sketches(fact, ["cuisine"]), "year", ["cuisine"])
    off = rolled.selectExpr("period", "cuisine", "orders", "customers * 2 AS customers", "restaurants", "timed_orders", "p50 + 9 AS p50", "p90")
    row = sketches.roll_up_check(fact, off, "year", ["cuisine"]).filter("cuisine = 'a'").first()
    assert (row["customers_within"], row["restaurants_within"], row["p50_within"], row["p90_within"]) == (False, True, False, True)


def test_empty_fact(spark):
    nothing = spark.createDataFrame([], FACT)
    assert sketches.roll_up(sketches.daily_sketches(nothing, ["cuisine"]), "month", ["cuisine"]).count() == 0


REVIEWS = "review_id bigint, rating bigint, comment string"


def test_shards_in_turns_and_one_killed(spark, tmp_path, monkeypatch):
    source, root = str(tmp_path / "reviews"), str(tmp_path / "out")
    models = {"plain": sample.plain_model}
    stored = spark.createDataFrame([("3", "neutral", 0.0, "t", None, None, "old")], REVIEW_ENRICHED)
    rows = [(i, 1 + i % 5, f"text {i}") for i in range(40)] + [(7, 1, "text again"), (90, 1, " "), (91, 1, None)]
    schema = spark.createDataFrame([], REVIEWS).schema

    def run(shard):
        jobs.stream_enrich(spark, source, schema, root, models, "2024-07-01 00:00:00", stored, shard, 2)

    tables.append_table(spark.createDataFrame(rows, REVIEWS), source)
    write = tables.replace_table

    def killed(df, path, partition_by=None):
        write(df, path, partition_by)
        if "/epoch=" in path:
            raise RuntimeError("killed")

    monkeypatch.setattr(tables, "replace_table", killed)
    with pytest.raises(Exception, match="killed"):
        run(0)
    monkeypatch.setattr(tables, "replace_table", write)
    run(1)
    run(0)
    tables.append_table(spark.createDataFrame([(i, 5, "late") for i in range(30, 50)], REVIEWS), source)
    run(0)
    run(1)
    ids = sorted(int(r["review_id"]) for r in jobs.stream_enriched(spark, root).collect())
    assert ids == sorted(set(range(50)) - {3})
    with pytest.raises(ValueError, match="number of shards"):
        jobs.stream_enrich(spark, source, schema, root, models, "2024-07-01 00:00:00", stored, 0, 3)
