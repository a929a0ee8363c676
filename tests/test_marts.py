"""Marts, data tests and the warehouse build on small hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from platter.operators.ranking import first_per_key
from platter.plans import catalogue, marts, quality, staging
from platter.plans.warehouse import Warehouse, build_all, current_build, publish_build
from platter.schemas import RAW_TABLES, describe_tables, empty_table

ORDERS = (
    "order_id bigint, order_timestamp timestamp, order_date date, customer_id bigint, restaurant_id bigint, city string, "
    "cuisine string, payment_method string, order_status string, is_delivered boolean, items_count bigint, "
    "sales_qty bigint, subtotal decimal(18,2), discount decimal(18,2), delivery_fee decimal(18,2), gst decimal(18,2), "
    "sales_amount decimal(18,2), customer_rating bigint, delivery_time_min bigint"
)
DAY = dt.date(2024, 5, 1)


def order(i, customer=1, restaurant=1, city="Goa", status="Delivered", amount="10.00", day=DAY, minutes=30, rating=4,
          cuisine="Thai", payment="Card", hour=9):
    return (
        i, dt.datetime(2024, 5, 1, hour), day, customer, restaurant, city, cuisine, payment, status,
        None if status is None else status == "Delivered", 1, 2, Decimal(amount), Decimal(0), Decimal(0), Decimal(0),
        Decimal(amount), rating, minutes,
    )


@pytest.fixture
def fact(spark):
    return spark.createDataFrame(
        [
            order(1), order(2, amount="10.05"), order(3, status="Cancelled", minutes=None, rating=None),
            order(4, customer=2, city="Pune", status="Cancelled", minutes=None, rating=None),
            order(5, customer=2, city=None, status="delivered", day=None, amount="7.00"),
            order(6, customer=3, city="Goa", status=None, cuisine=" ", payment=None),
            order(7, customer=4, city="Leh", day=None), order(8, customer=4, city="Ooty", day=None),
        ],
        ORDERS,
    )


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_daily_city_revenue(fact):
    got = by(marts.mart_daily_city_revenue(fact), "order_date", "city")
    goa = got[(DAY, "Goa")]
    assert (goa["orders"], goa["delivered_orders"]) == (4, 2)
    assert (goa["cancel_rate"], goa["gmv"], goa["aov"]) == (Decimal("0.25"), Decimal("20.05"), Decimal("10.03"))
    pune = got[(DAY, "Pune")]  # nothing delivered: revenue 0, no average
    assert (pune["gmv"], pune["aov"], pune["cancel_rate"]) == (Decimal(0), None, Decimal(1))


def test_status_case_matters_only_for_the_flag(fact):
    row = by(marts.mart_payment_performance(fact), "payment_method")[("Card",)]
    assert (row["delivered_orders"], row["successful_deliveries"]) == (5, 4)
    assert row["unique_customers"] == 3 and row["total_items_sold"] == 8


def test_blank_dimensions_are_dropped(fact):
    assert set(by(marts.mart_cuisine_performance(fact), "cuisine")) == {("Thai",)}
    assert set(by(marts.mart_payment_performance(fact), "payment_method")) == {("Card",)}


def test_customer_performance(spark, fact):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d"), (9, "z")], "customer_id bigint, customer_name string")
    got = by(marts.mart_customer_performance(dim, fact), "customer_id")
    assert got[(1,)]["total_spend"] == Decimal("20.05") and got[(1,)]["cancel_rate"] == Decimal("33.33")
    assert got[(2,)]["delivered_orders"] == 1 and got[(2,)]["city"] == "Pune"  # the later order has no city
    assert got[(4,)]["city"] == "Ooty"  # no date at all: the greatest order id decides
    none = got[(9,)]
    assert (none["total_orders"], none["total_spend"], none["cancel_rate"], none["city"]) == (0, 0, None, None)


def test_restaurant_fan_out(spark, fact):
    """A dimension row that occurs twice doubles counts and sums, exactly as joining first would."""
    dim = spark.createDataFrame(
        [(1, "A", "Goa", "Thai"), (1, "A", "Goa", "Thai"), (1, "B", "Goa", "Thai")],
        "restaurant_id bigint, restaurant_name string, city string, cuisine string",
    )
    extra = fact.unionByName(spark.createDataFrame([order(9, restaurant=None), order(10, restaurant=77)], ORDERS))
    got = by(marts.mart_restaurant_performance(extra, dim), "restaurant_id", "restaurant_name")
    naive = by(
        extra.select("restaurant_id", "is_delivered", "sales_amount", "customer_rating")
        .join(dim, "restaurant_id", "left")
        .groupBy("restaurant_id", "restaurant_name", "city", "cuisine")
        .agg(F.count(F.lit(1)).alias("orders"),
             F.sum(F.when(F.col("is_delivered"), F.col("sales_amount")).otherwise(0)).alias("revenue"),
             F.round(F.avg("customer_rating"), 2).alias("rating")),
        "restaurant_id", "restaurant_name",
    )
    assert got.keys() == naive.keys()
    for key, want in naive.items():
        assert (got[key]["orders"], got[key]["revenue"]) == (want["orders"], want["revenue"])
        assert float(got[key]["avg_customer_rating"]) == want["rating"]


def test_sla_exact_and_sketch(spark):
    fact = spark.createDataFrame([order(i, minutes=i) for i in range(1, 11)] + [order(11, status="Cancelled")], ORDERS)
    for exact in (True, False):
        row = marts.mart_delivery_sla(fact, exact).first()
        assert (row["order_hour"], row["delivered_orders"], row["p50"], row["p90"]) == (9, 10, 5.0, 9.0)


def test_dim_date(spark):
    days = marts.dim_date(spark)
    assert days.count() == 1096 and days.filter("is_weekend").count() == 312
    first = days.orderBy("date_day").first()
    assert (first["month_name"], first["day_name"], first["is_weekend"]) == ("January", "Monday", False)


def test_menu_and_restaurant_staging(spark):
    menu = spark.createDataFrame(
        [("m1", "1", "f", "c", "9.5"), ("m2", "x", "f", "c", "9"), ("m3", "1", "f", "c", "0"), ("m4", "1", "f", "c", "n/a")],
        "menu_id string, r_id string, f_id string, cuisine string, price string",
    )
    assert [r["menu_id"] for r in staging.stg_menu(menu).collect()] == ["m1"]
    places = spark.createDataFrame(
        [("7", "A", "X,Y", "--", "50+ ratings", "200", "c", "l"), ("no", "B", "Y", "4.1", "new", "x", "c", "l"),
         ("8", "C", "Z", "4.1", "Too Few", "x", "c", "l")],
        "id string, name string, city string, rating string, rating_count string, cost string, cuisine string, lic_no string",
    )
    got = by(staging.stg_restaurant(places), "restaurant_id")
    assert (got[(7,)]["rating"], got[(7,)]["rating_count"], got[(7,)]["cost_for_two"]) == (None, 50, 200)
    assert (got[(8,)]["rating"], got[(8,)]["rating_count"], got[(8,)]["cost_for_two"]) == (Decimal("4.1"), None, None)


def test_quality_checks(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "c"), (None, "a")], "k bigint, s string")
    assert rows(quality.unique_failures(df, "k")) == [(1, 2)]
    assert quality.not_null_failures(df, "k").count() == 2
    assert rows(quality.accepted_value_failures(df, "s", ["a"])) == [("b", 1), ("c", 1)]
    parent = spark.createDataFrame([(1,), (1,)], "p bigint")
    assert rows(quality.relationship_failures(df, "k", parent, "p")) == [(2, 1)]


def test_id_set_diff(spark, rows):
    left, right = (spark.createDataFrame([(i,) for i in ids], "k bigint") for ids in ([1, 1, 2], [2, 5]))
    assert rows(quality.id_set_diff(left, right, "k")) == [(1, "missing"), (5, "extra")]


def test_scratch_is_cleared(spark, tmp_path):
    from platter.session import clear_scratch, scratch_path
    from platter.sources.tables import exists

    class Other:
        """The session with a shared folder of its own."""

        def __getattr__(self, name):
            return getattr(spark, name)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: str(tmp_path) if key == "spark.checkpoint.dir" else spark.conf.get(key, default))

    other = Other()
    path = scratch_path(other, "t")
    spark.range(3).write.parquet(path)
    assert path.startswith(str(tmp_path)) and exists(spark, path)
    clear_scratch(other)
    assert not exists(spark, path) and tmp_path.exists()


def test_top_is_deterministic(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", None), ("d", 2)], "k string, v int")
    assert [r["k"] for r in catalogue.top(df, "v", ["k"], 3).collect()] == ["d", "a", "b"]
    assert catalogue.top(spark.range(700).toDF("v"), "v", ["v"], 500).count() == 500


def test_empty_landing_tables(spark):
    """Every silver table builds from the declared landing tables."""
    house = Warehouse(spark, {name: empty_table(spark, name) for name in RAW_TABLES})
    for name in ("stg_users", "stg_food", "stg_menu", "stg_orders", "stg_order_items", "stg_restaurant", "stg_reviews"):
        assert getattr(house, name).count() == 0
    assert describe_tables(spark).count() == sum(len(s.fields) for s in RAW_TABLES.values())


def test_hot_key_leaves_each_task_as_one_row(spark):
    """A third of all rows share one key; the rank limit sits below the shuffle."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    latest = first_per_key(df, ["k"], [F.col("v").desc()])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[:exchange] and "WindowGroupLimit" in plan[exchange:]
    assert latest.filter("k = 0").first()["v"] == 2997 and latest.count() == 2001


def test_build_all_and_failing_quality(spark, tmp_path):
    from platter.sources import sample

    sf = "/root/testdata/sf0.001"
    house = Warehouse(spark, sample.Landing(spark, sf), lambda: sample.review_enriched(spark, sf))
    counts = {r["table_name"]: r["row_count"] for r in build_all(house, str(tmp_path / "ok")).collect()}
    assert counts["raw.orders"] == counts["marts.fct_orders"] == 1500
    stored = spark.read.parquet(str(tmp_path / "ok/marts/mart_daily_city_revenue"))
    assert stored.count() == house.mart_daily_city_revenue.count()

    broken = dict(sample.Landing(spark, sf))
    broken["orders"] = broken["orders"].withColumn("order_status", F.lit("Lost"))
    with pytest.raises(ValueError, match="accepted_values_order_status"):
        build_all(Warehouse(spark, broken, house.enriched), str(tmp_path / "bad"))


def test_failed_builds_leave_the_current_one(spark, tmp_path):
    from platter.sources import sample

    sf, root = "/root/testdata/sf0.001", str(tmp_path)
    landing = dict(sample.Landing(spark, sf))
    with pytest.raises(ValueError, match="no finished build"):
        current_build(spark, root)
    first = publish_build(Warehouse(spark, landing), root)
    assert current_build(spark, root) == first

    lost = landing | {"orders": landing["orders"].withColumn("order_status", F.lit("Lost"))}
    with pytest.raises(ValueError, match="accepted_values_order_status"):
        publish_build(Warehouse(spark, lost), root)
    assert current_build(spark, root) == first
    assert spark.read.parquet(f"{first}/marts/fct_orders").count() == 1500

    # A switch that was killed before its pointer was complete.
    (tmp_path / "current" / "0000000001").mkdir()
    assert current_build(spark, root) == first
    fewer = landing | {"orders": landing["orders"].limit(10)}
    second = publish_build(Warehouse(spark, fewer), root)
    assert current_build(spark, root) == second != first
    assert spark.read.parquet(f"{second}/marts/fct_orders").count() == 10
    assert spark.read.parquet(f"{first}/marts/fct_orders").count() == 1500


def test_shuffle_sizing(spark):
    from platter.session import estimated_bytes, sized_shuffles

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    with sized_shuffles(spark, 1 << 20) as partitions:
        assert partitions == int(spark.conf.get("spark.sql.shuffle.partitions"))
    with sized_shuffles(spark, 1 << 40) as partitions:
        assert partitions == 2048 and spark.conf.get(name) == "2048"
    with sized_shuffles(spark, 1 << 50) as partitions:
        assert partitions == 1 << 21
    assert spark.conf.get(name, None) is None
    assert estimated_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) > 50_000


def test_food_mart_repeats_no_sums(spark):
    """Rows repeated per distinct count carry no measures, and the counts stay per item: nulls and repeats of an order included."""
    item = "order_item_id bigint, order_id bigint, restaurant_id bigint, f_id string, order_date date, city string, price decimal(18,2), quantity bigint, line_amount decimal(18,2)"
    one = Decimal("1.50")
    items = spark.createDataFrame(
        [
            (1, 1, 1, "a", DAY, "Goa", one, 2, one), (2, 1, 2, "a", DAY, "Goa", one, None, None), (3, 2, 1, "a", None, None, None, 1, one),
            (4, 2, None, "b", None, None, one, 1, one), (5, None, 3, None, DAY, "Leh", one, 1, one),
        ],
        item,
    )
    food = spark.createDataFrame([("a", "A", "Veg"), ("b", "B", "Veg"), ("c", "C", None), (None, "N", None)], "f_id string, food_name string, veg_or_non_veg string")
    got = marts.mart_food_performance(food, items)
    repeated = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Expand" in line]
    assert repeated and not any("line_amount" in line or "price" in line for line in repeated)
    rows = {r.f_id: r for r in got.collect()}
    assert {k: (r.total_orders, r.total_order_items, r.total_quantity_sold, r.restaurants_selling, r.cities_selling) for k, r in rows.items()} == {
        "a": (2, 3, 3, 2, 1), "b": (1, 1, 1, 0, 0), "c": (0, 0, 0, 0, 0), None: (0, 0, 0, 0, 0),
    }
    assert rows["a"].total_revenue == 3 and rows["c"].first_order_date is None
