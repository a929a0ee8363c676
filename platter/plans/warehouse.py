"""The layered warehouse: landing tables in, lazily built silver and gold tables out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.plans import marts, quality, staging
from platter.schemas import LAYERS
from platter.session import estimated_bytes, sized_shuffles
from platter.sources import tables


class Warehouse:
    """DataFrames of every layer, built on first use from the landing tables."""

    def __init__(
        self,
        spark: SparkSession,
        raw: Mapping[str, DataFrame],
        enriched: Callable[[], DataFrame] | None = None,
    ):
        self.spark = spark
        self.raw = raw
        self.enriched = enriched

    @cached_property
    def review_enriched(self) -> DataFrame:
        return self.enriched()

    # silver
    @cached_property
    def stg_users(self) -> DataFrame:
        return staging.stg_users(self.raw["users"])

    @cached_property
    def stg_food(self) -> DataFrame:
        return staging.stg_food(self.raw["food"])

    @cached_property
    def stg_menu(self) -> DataFrame:
        return staging.stg_menu(self.raw["menu"])

    @cached_property
    def stg_orders(self) -> DataFrame:
        return staging.stg_orders(self.raw["orders"])

    @cached_property
    def stg_order_items(self) -> DataFrame:
        return staging.stg_order_items(self.raw["order_items"])

    @cached_property
    def stg_restaurant(self) -> DataFrame:
        return staging.stg_restaurant(self.raw["restaurant"])

    @cached_property
    def stg_reviews(self) -> DataFrame:
        return staging.stg_reviews(self.raw["reviews"], self.stg_restaurant)

    # gold
    @cached_property
    def dim_customer(self) -> DataFrame:
        return marts.dim_customer(self.stg_users)

    @cached_property
    def dim_food(self) -> DataFrame:
        return marts.dim_food(self.stg_food)

    @cached_property
    def dim_restaurant(self) -> DataFrame:
        return marts.dim_restaurant(self.stg_restaurant)

    @cached_property
    def dim_date(self) -> DataFrame:
        return marts.dim_date(self.spark)

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.stg_orders)

    @cached_property
    def fact_order_items(self) -> DataFrame:
        return marts.fact_order_items(self.stg_order_items, self.stg_orders)

    @cached_property
    def mart_daily_city_revenue(self) -> DataFrame:
        return marts.mart_daily_city_revenue(self.fct_orders)

    @cached_property
    def mart_delivery_sla(self) -> DataFrame:
        return marts.mart_delivery_sla(self.fct_orders)

    @cached_property
    def mart_restaurant_performance(self) -> DataFrame:
        return marts.mart_restaurant_performance(self.fct_orders, self.dim_restaurant)

    @cached_property
    def mart_food_performance(self) -> DataFrame:
        return marts.mart_food_performance(self.dim_food, self.fact_order_items)

    @cached_property
    def mart_customer_performance(self) -> DataFrame:
        return marts.mart_customer_performance(self.dim_customer, self.fct_orders)

    @cached_property
    def mart_cuisine_performance(self) -> DataFrame:
        return marts.mart_cuisine_performance(self.fct_orders)

    @cached_property
    def mart_payment_performance(self) -> DataFrame:
        return marts.mart_payment_performance(self.fct_orders)

    @cached_property
    def mart_review_insights(self) -> DataFrame:
        return marts.mart_review_insights(self.review_enriched, self.stg_reviews)


SILVER = (
    "stg_users", "stg_food", "stg_menu", "stg_orders", "stg_order_items", "stg_restaurant", "stg_reviews",
)
DIMENSIONS = ("dim_customer", "dim_food", "dim_restaurant", "dim_date")
MARTS = (
    "mart_daily_city_revenue", "mart_delivery_sla", "mart_restaurant_performance", "mart_food_performance",
    "mart_customer_performance", "mart_cuisine_performance", "mart_payment_performance",
)
ENRICHMENT_MARTS = ("mart_review_insights",)


def register_views(house: Warehouse) -> None:
    """Temp views of the silver layer and the item fact, which stay unmaterialised."""
    for name in (*SILVER, "fact_order_items"):
        getattr(house, name).createOrReplaceTempView(name)


def build_all(house: Warehouse, out_dir: str, with_enrichment: bool = True) -> DataFrame:
    """Write landing copies, dimensions, the order fact and all marts; check quality in between.

    The order fact is written once, partitioned by month, and every mart reads the
    written table. Returns (layer, table_name, row_count) of what was written.
    """
    spark = house.spark

    def path(layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return f"{out_dir}/{layer}/{name}"

    for name, df in house.raw.items():
        tables.replace_table(df, path("raw", name))
    landed = {name: spark.read.parquet(path("raw", name)) for name in house.raw}
    with sized_shuffles(spark, sum(estimated_bytes(df) for df in landed.values())):
        built = Warehouse(spark, landed, house.enriched)
        register_views(built)

        for name in DIMENSIONS:
            tables.replace_table(getattr(built, name), path("marts", name))
        by_month = built.fct_orders.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
        # One file set per month; the rebalance splits a large month and joins small ones.
        balanced = by_month.hint("rebalance", "order_month")
        tables.replace_table(balanced, path("marts", "fct_orders"), partition_by=["order_month"])

        built.__dict__["fct_orders"] = spark.read.parquet(path("marts", "fct_orders")).drop("order_month")
        for name in DIMENSIONS:
            built.__dict__[name] = spark.read.parquet(path("marts", name))
        quality.require(quality.order_fact_violations(built.fct_orders, built.dim_customer))

        wanted = MARTS + (ENRICHMENT_MARTS if with_enrichment and house.enriched is not None else ())
        for name in wanted:
            tables.replace_table(getattr(built, name), path("marts", name))

        written = [("raw", n) for n in house.raw] + [("marts", n) for n in (*DIMENSIONS, "fct_orders", *wanted)]
    return tables.row_counts(
        {f"{layer}.{name}": spark.read.parquet(path(layer, name)) for layer, name in written}
    )


def publish_build(house: Warehouse, root: str, with_enrichment: bool = True) -> str:
    """Builds into a folder of its own and makes it the current build; returns that folder.

    Readers change over with one small pointer table, written after all data tests have passed. A build that
    fails or is killed leaves the current one as it was. Of two builds that end at once the second one to switch fails. Older
    builds stay on disk for readers that still use them.
    """
    spark = house.spark
    name = uuid.uuid4().hex
    build_all(house, f"{root}/builds/{name}", with_enrichment)
    following = max(_pointers(spark, root), default=-1) + 1
    pointer = spark.createDataFrame([(name,)], "build string").coalesce(1)
    pointer.write.parquet(f"{root}/current/{following:010d}")
    return f"{root}/builds/{name}"


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all pointers, those of killed switches among them."""
    place = f"{root}/current"
    return [int(n) for n in tables.names(spark, place) if n.isdigit()] if tables.exists(spark, place) else []


def current_build(spark: SparkSession, root: str) -> str:
    """Folder of the build whose pointer is complete and latest."""
    for number in sorted(_pointers(spark, root), reverse=True):
        pointer = f"{root}/current/{number:010d}"
        if tables.exists(spark, f"{pointer}/_SUCCESS"):
            return f"{root}/builds/{spark.read.parquet(pointer).first()['build']}"
    raise ValueError(f"no finished build below {root}")
