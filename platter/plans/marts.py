"""Gold layer: dimensions, facts and performance marts.

Money stays DECIMAL; averages and rates are NUMERIC rounded half away from zero.
Aggregates pre-combine on the map side, so one hot key costs one partial row per
task, and dimensions are joined after aggregating.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C


def _flagged() -> Column:
    """Delivered by the exact, case-sensitive flag."""
    return F.col("is_delivered")


def _status_is(status: str) -> Column:
    """Order status in any letter case."""
    return F.lower("order_status") == status


# --------------------------------------------------------------------- dimensions
def dim_customer(stg_users: DataFrame) -> DataFrame:
    age = F.col("age")
    segment = (
        F.when(age < 25, "Gen Z")
        .when(age < 40, "Millennial")
        .when(age < 55, "Gen X")
        .when(age.isNull(), "Unknown")
        .otherwise("Boomer")
    )
    return stg_users.select(
        "customer_id", "customer_name", "email", "age", segment.alias("age_segment"), "gender", "marital_status",
        "occupation", "income_band", "education", "family_size",
    )


def dim_food(stg_food: DataFrame) -> DataFrame:
    return stg_food.select("f_id", "food_name", "veg_or_non_veg")


def dim_restaurant(stg_restaurant: DataFrame) -> DataFrame:
    return stg_restaurant.select(
        "restaurant_id", "restaurant_name", "city", "cuisine", "rating", "rating_count", "cost_for_two"
    )


def with_date_attributes(days: DataFrame) -> DataFrame:
    return days.select(
        "date_day",
        F.year("date_day").alias("year"),
        F.month("date_day").alias("month"),
        F.date_format("date_day", "MMMM").alias("month_name"),
        F.date_format("date_day", "EEEE").alias("day_name"),
        F.dayofweek("date_day").isin(1, 7).alias("is_weekend"),
    )


def _every_day(bounds: DataFrame) -> DataFrame:
    return bounds.select(
        F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("date_day")
    )


def dim_date(spark: SparkSession, first: str = "2024-01-01", last: str = "2026-12-31") -> DataFrame:
    """One row per calendar day of a fixed range."""
    bounds = spark.range(1).select(
        F.lit(first).cast("date").alias("first_day"), F.lit(last).cast("date").alias("last_day")
    )
    return with_date_attributes(_every_day(bounds))


def dim_date_covering(fact: DataFrame, column: str) -> DataFrame:
    """One row per calendar day between the first and the last day of a fact."""
    bounds = fact.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day"))
    return with_date_attributes(_every_day(bounds))


# -------------------------------------------------------------------------- facts
def fct_orders(stg_orders: DataFrame) -> DataFrame:
    return stg_orders.select(
        "order_id", "order_timestamp", "order_date", "customer_id", "restaurant_id", "city", "cuisine",
        "payment_method", "order_status", "is_delivered", "items_count", "sales_qty", "subtotal", "discount",
        "delivery_fee", "gst", "sales_amount", "customer_rating", "delivery_time_min",
    )


def fact_order_items(stg_order_items: DataFrame, stg_orders: DataFrame) -> DataFrame:
    orders = stg_orders.select(
        "order_id",
        F.col("order_timestamp").alias("order_ts"),
        F.to_date("order_date").alias("order_date"),
        "city",
    )
    # Two facts: neither is broadcast, however small its compressed files look, and
    # a skewed order is split by the adaptive skew join.
    return stg_order_items.join(orders.hint("merge"), "order_id").select(
        "order_item_id", "order_id", "restaurant_id", "f_id", "order_ts", "order_date", "city", "price",
        "quantity", "line_amount",
    )


# -------------------------------------------------------------------------- marts
def _sum_if(condition: Column, value: str) -> Column:
    """SUM(IF(condition, value, 0)): 0 where the condition never holds, NULL only for no rows at all."""
    return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0)))


def _mean(total: Column, count: Column, digits: int) -> Column:
    return C.rounded_share(total, count, digits)


def _order_measures(*distinct: tuple[str, str]) -> list[Column]:
    rated = F.col("customer_rating")
    return [
        F.count(F.lit(1)).alias("total_orders"),
        *[F.countDistinct(column).alias(name) for column, name in distinct],
        F.count_if(_status_is("delivered")).alias("delivered_orders"),
        F.count_if(_status_is("cancelled")).alias("cancelled_orders"),
        F.count_if(_flagged()).alias("successful_deliveries"),
        _sum_if(_flagged(), "sales_qty").alias("total_items_sold"),
        _sum_if(_flagged(), "sales_amount").alias("total_revenue"),
        F.sum(F.when(_flagged(), F.col("sales_amount"))).alias("_spend"),
        F.count(F.when(_flagged(), F.col("sales_amount"))).alias("_spend_n"),
        F.sum(rated).alias("_rating"),
        F.count(rated).alias("_rating_n"),
        F.sum(F.when(_flagged(), F.col("delivery_time_min"))).alias("_minutes"),
        F.count(F.when(_flagged(), F.col("delivery_time_min"))).alias("_minutes_n"),
    ]


def _order_rates() -> list[Column]:
    return [
        F.round("total_revenue", 2).alias("total_revenue"),
        _mean(F.col("_spend"), F.col("_spend_n"), 2).alias("average_order_value"),
        _mean(F.col("_rating"), F.col("_rating_n"), 2).alias("average_customer_rating"),
        _mean(F.col("_minutes"), F.col("_minutes_n"), 2).alias("average_delivery_time_min"),
        C.rounded_share(F.col("cancelled_orders"), F.col("total_orders"), 2, 100).alias("cancel_rate"),
        C.rounded_share(F.col("delivered_orders"), F.col("total_orders"), 2, 100).alias("delivery_success_rate"),
    ]


def mart_cuisine_performance(fct_orders: DataFrame) -> DataFrame:
    grouped = (
        fct_orders.filter(C.not_blank(F.col("cuisine")))
        .groupBy("cuisine")
        .agg(
            *_order_measures(("restaurant_id", "restaurants_count"), ("city", "cities_count")),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    return grouped.select(
        "cuisine", "total_orders", "delivered_orders", "cancelled_orders", "successful_deliveries",
        "restaurants_count", "cities_count", "total_items_sold", *_order_rates(), "first_order_date",
        "last_order_date",
    )


def mart_payment_performance(fct_orders: DataFrame) -> DataFrame:
    grouped = (
        fct_orders.filter(C.not_blank(F.col("payment_method")))
        .groupBy("payment_method")
        .agg(
            *_order_measures(
                ("customer_id", "unique_customers"),
                ("restaurant_id", "unique_restaurants"),
                ("city", "cities_count"),
            )
        )
    )
    return grouped.select(
        "payment_method", "total_orders", "unique_customers", "unique_restaurants", "cities_count",
        "delivered_orders", "cancelled_orders", "successful_deliveries", "total_items_sold", *_order_rates(),
    )


def customer_activity(fct_orders: DataFrame) -> DataFrame:
    """Per customer: counts, spend and latest known city, in one shuffle of the fact.

    The latest city is the one of the greatest (date, timestamp, order) with a
    known city, also where every date is NULL.
    """
    located = F.when(
        F.col("city").isNotNull(),
        F.struct("order_date", "order_timestamp", "order_id", "city"),
    )
    spend = F.when(_status_is("delivered"), F.col("sales_amount"))
    rating = F.when(_status_is("delivered"), F.col("customer_rating"))
    return fct_orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(_status_is("delivered")).alias("delivered_orders"),
        F.count_if(_status_is("cancelled")).alias("cancelled_orders"),
        _sum_if(_status_is("delivered"), "sales_amount").alias("total_spend"),
        F.sum(spend).alias("_spend"),
        F.count(spend).alias("_spend_n"),
        F.sum(rating).alias("_rating"),
        F.count(rating).alias("_rating_n"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.max(located)["city"].alias("city"),
    )


def customer_latest_city(fct_orders: DataFrame) -> DataFrame:
    return customer_activity(fct_orders).select("customer_id", F.col("city").alias("latest_city"))


def mart_customer_performance(dim_customer: DataFrame, fct_orders: DataFrame) -> DataFrame:
    zero = F.lit(0).cast(C.NUMERIC)
    joined = dim_customer.join(customer_activity(fct_orders), "customer_id", "left")
    return joined.select(
        *dim_customer.columns,
        "city",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("delivered_orders", F.lit(0)).alias("delivered_orders"),
        F.coalesce("cancelled_orders", F.lit(0)).alias("cancelled_orders"),
        F.coalesce("total_spend", F.lit(0)).alias("total_spend"),
        F.coalesce(_mean(F.col("_spend"), F.col("_spend_n"), 2), zero).alias("average_order_value"),
        F.coalesce(_mean(F.col("_rating"), F.col("_rating_n"), 2), zero).alias("average_rating_given"),
        C.rounded_share(F.col("cancelled_orders"), F.col("total_orders"), 2, 100).alias("cancel_rate"),
        "first_order_date",
        "last_order_date",
    )


def mart_food_performance(dim_food: DataFrame, fact_order_items: DataFrame) -> DataFrame:
    """Sales per food item.

    Several distinct counts repeat every row per count, so the sums stand beside one of them only: that of the orders, by which
    the fact is distributed already. The repeated rows hold no more than the item and the counted values.
    """
    zero = F.lit(0).cast(C.NUMERIC)
    sold = fact_order_items.groupBy("f_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.count(F.lit(1)).alias("total_order_items"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("line_amount").alias("total_revenue"),
        F.count("line_amount").alias("_lines"),
        F.sum("price").alias("_price"),
        F.count("price").alias("_prices"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
    )
    places = fact_order_items.groupBy("f_id").agg(
        F.countDistinct("restaurant_id").alias("restaurants_selling"),
        F.countDistinct("city").alias("cities_selling"),
    )
    return dim_food.join(sold, "f_id", "left").join(places, "f_id", "left").select(
        "f_id",
        "food_name",
        "veg_or_non_veg",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_order_items", F.lit(0)).alias("total_order_items"),
        F.coalesce("total_quantity_sold", F.lit(0)).alias("total_quantity_sold"),
        F.round(F.coalesce("total_revenue", F.lit(0)), 2).alias("total_revenue"),
        F.coalesce(_mean(F.col("_price"), F.col("_prices"), 2), zero).alias("average_item_price"),
        F.coalesce(_mean(F.col("total_revenue"), F.col("_lines"), 2), zero).alias("average_line_amount"),
        F.coalesce("restaurants_selling", F.lit(0)).alias("restaurants_selling"),
        F.coalesce("cities_selling", F.lit(0)).alias("cities_selling"),
        "first_order_date",
        "last_order_date",
    )


def mart_restaurant_performance(fct_orders: DataFrame, dim_restaurant: DataFrame) -> DataFrame:
    """Orders, revenue and averages per restaurant and its attributes.

    The fact is reduced to one row per restaurant before the dimension is joined.
    A dimension row that occurs n times would fan every order out n times, so
    counts and sums are multiplied by n; averages are unchanged by it.
    """
    keys = ["restaurant_id", "restaurant_name", "city", "cuisine"]
    activity = fct_orders.groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("orders"),
        _sum_if(_flagged(), "sales_amount").alias("revenue"),
        F.sum("customer_rating").alias("_rating"),
        F.count("customer_rating").alias("_rating_n"),
        F.sum("delivery_time_min").alias("_minutes"),
        F.count("delivery_time_min").alias("_minutes_n"),
    )
    places = dim_restaurant.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    return activity.join(places, "restaurant_id", "left").select(
        *keys,
        (F.col("orders") * copies).alias("orders"),
        (F.col("revenue") * copies.cast("decimal(10,0)")).alias("revenue"),
        _mean(F.col("_rating"), F.col("_rating_n"), 2).alias("avg_customer_rating"),
        _mean(F.col("_minutes"), F.col("_minutes_n"), 1).alias("avg_delivery_min"),
    )


def mart_daily_city_revenue(fct_orders: DataFrame) -> DataFrame:
    grouped = fct_orders.groupBy("order_date", "city").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(_flagged()).alias("delivered_orders"),
        F.count_if(F.col("order_status") == "Cancelled").alias("_cancelled"),
        _sum_if(_flagged(), "sales_amount").alias("gmv"),
    )
    return grouped.select(
        "order_date",
        "city",
        "orders",
        "delivered_orders",
        C.rounded_share(F.col("_cancelled"), F.col("orders"), 4).alias("cancel_rate"),
        "gmv",
        _mean(F.col("gmv"), F.col("delivered_orders"), 2).alias("aov"),
    )


def mart_delivery_sla(fct_orders: DataFrame, exact: bool = True) -> DataFrame:
    """Median and 90th percentile delivery minutes per city and hour of delivered orders.

    Minutes take few distinct values, so the exact form keeps a small mergeable
    value-to-count map; ``exact=False`` uses the mergeable quantile sketch.
    """
    if exact:
        p50 = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delivery_time_min)")
        p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY delivery_time_min)")
    else:
        p50 = F.percentile_approx("delivery_time_min", 0.5, 10000)
        p90 = F.percentile_approx("delivery_time_min", 0.9, 10000)
    return (
        fct_orders.filter(_flagged())
        .groupBy("city", F.hour("order_timestamp").alias("order_hour"))
        .agg(
            F.count_if(_flagged()).alias("delivered_orders"),
            F.round(p50.cast("double"), 1).alias("p50"),
            F.round(p90.cast("double"), 1).alias("p90"),
        )
    )


def mart_review_insights(review_enriched: DataFrame, stg_reviews: DataFrame) -> DataFrame:
    """Per city, topic and label over every stored enrichment row; ids meet as strings."""
    reviews = stg_reviews.select(F.col("review_id").cast("string").alias("review_id"), "city", "rating")
    return (
        review_enriched.select("review_id", "topic", "sentiment_label", "sentiment_score", "key_issue")
        .join(reviews, "review_id")
        .groupBy("city", "topic", "sentiment_label")
        .agg(
            F.count(F.lit(1)).alias("reviews"),
            F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment_score"),
            C.rounded_share(F.sum("rating"), F.count("rating"), 2).alias("avg_star_rating"),
            F.count("key_issue").alias("flagged_issues"),
        )
    )


def multi_distinct(fct_orders: DataFrame, exact: bool = True) -> DataFrame:
    """Several distinct counts per cuisine in one pass; ``exact=False`` uses mergeable sketches."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    return fct_orders.groupBy("cuisine").agg(
        distinct("customer_id").alias("customers"),
        distinct("restaurant_id").alias("restaurants"),
        distinct("city").alias("cities"),
        distinct("payment_method").alias("payment_methods"),
    )


def kpi_overall(fct_orders: DataFrame) -> DataFrame:
    """One row: orders, delivered, GMV, AOV and cancellation rate over all orders."""
    totals = fct_orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(_flagged()).alias("delivered_orders"),
        F.count_if(_status_is("cancelled")).alias("cancelled_orders"),
        _sum_if(_flagged(), "sales_amount").alias("gmv"),
    )
    return totals.select(
        "total_orders",
        "delivered_orders",
        "gmv",
        _mean(F.col("gmv"), F.col("delivered_orders"), 2).alias("aov"),
        C.rounded_share(F.col("cancelled_orders"), F.col("total_orders"), 2, 100).alias("cancel_rate"),
    )
