"""Silver layer: typed, renamed and filtered views over the landing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C


def stg_users(users: DataFrame) -> DataFrame:
    return users.select(
        C.safe_int(F.col("user_id")).alias("customer_id"),
        F.col("name").alias("customer_name"),
        F.lower("email").alias("email"),
        C.safe_int(F.col("Age")).alias("age"),
        F.col("Gender").alias("gender"),
        F.col("`Marital Status`").alias("marital_status"),
        F.col("Occupation").alias("occupation"),
        F.col("`Monthly Income`").alias("income_band"),
        F.col("`Educational Qualifications`").alias("education"),
        C.safe_int(F.col("`Family size`")).alias("family_size"),
    ).filter(F.col("customer_id").isNotNull())


def stg_food(food: DataFrame) -> DataFrame:
    return food.filter(F.col("f_id").isNotNull()).select(
        "f_id",
        F.col("item").alias("food_name"),
        C.initcap_words(F.col("veg_or_non_veg")).alias("veg_or_non_veg"),
    )


def stg_menu(menu: DataFrame) -> DataFrame:
    return menu.select(
        "menu_id",
        C.safe_int(F.col("r_id")).alias("restaurant_id"),
        "f_id",
        "cuisine",
        C.safe_numeric(menu, "price").alias("price"),
    ).filter(F.col("restaurant_id").isNotNull() & (F.col("price") > 0))


def stg_orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        "order_id",
        F.col("order_timestamp").try_cast("timestamp").alias("order_timestamp"),
        "order_date",
        F.col("user_id").alias("customer_id"),
        C.safe_int(F.col("r_id")).alias("restaurant_id"),
        C.last_comma_part(F.col("restaurant_city")).alias("city"),
        "cuisine",
        "items_count",
        "sales_qty",
        "subtotal",
        "discount",
        "delivery_fee",
        "gst",
        "sales_amount",
        "currency",
        "payment_method",
        "order_status",
        (F.col("order_status") == "Delivered").alias("is_delivered"),
        "customer_rating",
        "delivery_time_min",
    )


def stg_order_items(items: DataFrame) -> DataFrame:
    return items.select(
        "order_item_id",
        "order_id",
        C.safe_int(F.col("r_id")).alias("restaurant_id"),
        "f_id",
        C.safe_numeric(items, "price").alias("price"),
        C.safe_int(F.col("quantity")).alias("quantity"),
        C.safe_numeric(items, "line_amount").alias("line_amount"),
    )


def stg_restaurant(restaurant: DataFrame) -> DataFrame:
    return restaurant.select(
        C.safe_int(F.col("id")).alias("restaurant_id"),
        F.col("name").alias("restaurant_name"),
        C.last_comma_part(F.col("city")).alias("city"),
        F.nullif(F.col("rating"), F.lit("--")).try_cast(C.NUMERIC).alias("rating"),
        C.safe_int(C.extract_or_null(F.col("rating_count").cast("string"), "[0-9]+")).alias("rating_count"),
        C.safe_int(F.col("cost")).alias("cost_for_two"),
        "cuisine",
        F.col("lic_no").alias("license_no"),
    ).filter(F.col("restaurant_id").isNotNull())


def stg_reviews(reviews: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Reviews with the city of their restaurant; ids meet as strings, repeated ids fan out."""
    cities = restaurants.select(F.col("restaurant_id").cast("string").alias("restaurant_id"), "city")
    return (
        reviews.filter(F.col("comment").isNotNull())
        .select(
            "review_id",
            "order_id",
            C.safe_int(F.col("user_id")).alias("customer_id"),
            F.col("restaurant_id").cast("string").alias("restaurant_id"),
            C.safe_int(F.col("rating")).alias("rating"),
            F.col("comment").cast("string").alias("comment"),
            F.col("review_date").try_cast("date").alias("review_date"),
        )
        .join(cities, "restaurant_id", "left")
        .select(
            "review_id", "order_id", "customer_id", "restaurant_id", "rating", "comment", "review_date", "city"
        )
    )


def usable_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews whose comment holds any text."""
    return reviews.filter(C.not_blank(F.col("comment")))
