"""Question catalogue: the user-level questions, answered from the smallest table that holds the answer.

Ties are broken by key so that every answer is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C


def top(df: DataFrame, measure: str, keys: list[str], n: int = 10, descending: bool = True) -> DataFrame:
    """The n best rows by a measure, NULL measures last, ties by key."""
    first = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
    return df.orderBy(first, *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def cities_by_gmv(daily_city: DataFrame, n: int = 10) -> DataFrame:
    totals = daily_city.groupBy("city").agg(F.sum("gmv").alias("gmv"), F.sum("orders").alias("orders"))
    return top(totals, "gmv", ["city"], n)


def cuisines_by_orders(cuisine_mart: DataFrame, n: int = 10) -> DataFrame:
    return top(cuisine_mart.select("cuisine", "total_orders", "total_revenue"), "total_orders", ["cuisine"], n)


RESTAURANT_MEASURES = {"revenue": "revenue", "orders": "orders", "rating": "avg_customer_rating"}


def restaurants_by(restaurant_mart: DataFrame, measure: str, n: int = 10, city: str | None = None) -> DataFrame:
    """Top restaurants by 'revenue', 'orders' or 'rating', in one city if given."""
    named = restaurant_mart.filter(F.col("restaurant_name").isNotNull())
    if city is not None:
        named = named.filter(F.lower("city") == city.lower())
    return top(named, RESTAURANT_MEASURES[measure], ["restaurant_id"], n)


def best_restaurant_per_city(restaurant_mart: DataFrame, measure: str = "revenue") -> DataFrame:
    from platter.operators.ranking import first_per_key

    named = restaurant_mart.filter(F.col("restaurant_name").isNotNull())
    order = [F.col(RESTAURANT_MEASURES[measure]).desc_nulls_last(), F.col("restaurant_id")]
    return first_per_key(named, ["city"], order).select(
        "city", "restaurant_id", "restaurant_name", "orders", "revenue", "avg_customer_rating"
    )


def delivery_time_by_city(fct_orders: DataFrame) -> DataFrame:
    """Mean and median minutes per city over delivered orders, from the order fact."""
    return (
        fct_orders.filter("is_delivered")
        .groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("delivered_orders"),
            C.rounded_share(F.sum("delivery_time_min"), F.count("delivery_time_min"), 2).alias("avg_delivery_min"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delivery_time_min)")
            .cast("double")
            .alias("median_delivery_min"),
        )
    )


def fastest_cities(fct_orders: DataFrame, n: int = 10) -> DataFrame:
    return top(delivery_time_by_city(fct_orders), "avg_delivery_min", ["city"], n, descending=False)


def cities_by_cancellation(fct_orders: DataFrame, n: int = 10) -> DataFrame:
    """Cancelled share per city recomputed from counts; daily rates are never averaged."""
    rates = (
        fct_orders.groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(F.lower("order_status") == "cancelled").alias("cancelled_orders"),
        )
        .withColumn("cancel_rate", C.rounded_share(F.col("cancelled_orders"), F.col("orders"), 2, 100))
    )
    return top(rates, "cancel_rate", ["city"], n)


def _frequency(df: DataFrame, column: str, n: int) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("reviews"))
    return top(counts, "reviews", [column], n)


def negative_topics(latest: DataFrame, n: int = 10) -> DataFrame:
    return _frequency(latest.filter(F.col("sentiment_label") == "negative"), "topic", n)


def common_complaints(latest: DataFrame, n: int = 10) -> DataFrame:
    return _frequency(latest.filter(F.col("sentiment_label") == "negative"), "key_issue", n)


def sentiment_summary(latest: DataFrame) -> DataFrame:
    def labelled(label: str) -> Column:
        return F.count_if(F.col("sentiment_label") == label).alias(f"{label}_reviews")

    return latest.agg(
        F.count(F.lit(1)).alias("enriched_reviews"),
        F.round(F.avg("sentiment_score"), 3).alias("avg_sentiment_score"),
        labelled("positive"),
        labelled("neutral"),
        labelled("negative"),
    )


def highest_spending_customers(customer_mart: DataFrame, n: int = 10) -> DataFrame:
    return top(
        customer_mart.select("customer_id", "customer_name", "city", "total_orders", "total_spend"),
        "total_spend",
        ["customer_id"],
        n,
    )


def payment_methods_by_orders(payment_mart: DataFrame, n: int = 10) -> DataFrame:
    return top(
        payment_mart.select("payment_method", "total_orders", "total_revenue"), "total_orders", ["payment_method"], n
    )


def reviews_with_enrichment(reviews: DataFrame, latest: DataFrame) -> DataFrame:
    """Every review with its latest enrichment, if any."""
    enriched = latest.select("review_id", "sentiment_label", "sentiment_score", "topic", "key_issue")
    return (
        reviews.withColumn("review_id", F.col("review_id").cast("string"))
        .join(enriched, "review_id", "left")
        .select(
            "review_id", C.safe_int(F.col("rating")).alias("rating"), F.col("comment").cast("string").alias("comment"),
            "review_date", "sentiment_label", "sentiment_score", "topic", "key_issue",
        )
    )


# ------------------------------------------------------------- questions that mix both
def reviews_of_top_restaurant(restaurant_mart: DataFrame, reviews: DataFrame, measure: str) -> DataFrame:
    """All usable reviews of the best restaurant, found by its key."""
    winner = restaurants_by(restaurant_mart, measure, 1).select(
        F.col("restaurant_id").cast("string").alias("_winner"), "restaurant_name"
    )
    return (
        reviews.filter(C.not_blank(F.col("comment")))
        .join(F.broadcast(winner), F.col("restaurant_id").cast("string") == F.col("_winner"))
        .drop("_winner")
    )


def corpus_of_top_restaurant(
    restaurant_mart: DataFrame, reviews: DataFrame, corpus: DataFrame, measure: str
) -> DataFrame:
    """The review vectors of the best restaurant, the corpus for evidence about it."""
    ids = reviews_of_top_restaurant(restaurant_mart, reviews, measure).select("review_id").distinct()
    return corpus.join(ids, "review_id", "left_semi")


def topics_in_city(city: DataFrame, review_insights: DataFrame) -> DataFrame:
    """Review topics of the one city a ranking returned."""
    winner = F.broadcast(city.select("city").limit(1))
    return review_insights.join(winner, "city", "left_semi").groupBy("city", "topic", "sentiment_label").agg(
        F.sum("reviews").alias("reviews"), F.sum("flagged_issues").alias("flagged_issues")
    )


def reviews_of_best_cuisine(cuisine_mart: DataFrame, fct_orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Usable reviews of orders of the cuisine with most orders."""
    winner = F.broadcast(cuisines_by_orders(cuisine_mart, 1).select("cuisine"))
    orders = fct_orders.select("order_id", "cuisine").join(winner, "cuisine", "left_semi")
    return (
        reviews.filter(C.not_blank(F.col("comment")))
        .join(orders, "order_id")
        .select("cuisine", "review_id", "order_id", "rating", "comment")
    )
