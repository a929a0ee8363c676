"""Daily sketches of the order fact that roll up to any longer period without reading the fact again.

Distinct counts are HyperLogLog sketches, delivery minutes a KLL sketch. Both merge, so a table with a row per day
and key answers for every month, quarter or year, and a new day only adds rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 2^12 registers: a standard error of 1.04 / 64, about 1.6 % of the count.
HLL_LOG2 = 12
# Items of the largest KLL level: a rank error of about 1.3 % of the rows at 99 % confidence.
KLL_ITEMS = 200
# What the checks allow: three standard errors of a count, over two of a rank.
COUNT_BOUND = 0.05
RANK_BOUND = 0.03

# Sketch column and the fact's column that it counts.
DISTINCT = {"customers": "customer_id", "restaurants": "restaurant_id"}
QUANTILES = {"p50": 0.5, "p90": 0.9}


def daily_sketches(fct_orders: DataFrame, keys: list[str]) -> DataFrame:
    """One row per day and keys: orders, a sketch per distinct count, and one of the minutes of delivered orders.

    Null values are in no sketch. Sketches combine inside the tasks, so a hot key shuffles one sketch per task.
    """
    minutes = F.when(F.col("is_delivered"), F.col("delivery_time_min").cast("bigint"))
    return fct_orders.groupBy("order_date", *keys).agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.hll_sketch_agg(F.col(c).cast("string"), HLL_LOG2).alias(f"{name}_sketch") for name, c in DISTINCT.items()],
        F.count(minutes).alias("timed_orders"),
        F.kll_sketch_agg_bigint(minutes, KLL_ITEMS).alias("minutes_sketch"),
    )


def _estimates(merged: DataFrame, kept: list[str]) -> DataFrame:
    timed = F.col("timed_orders") > 0
    return merged.select(
        *kept,
        "orders",
        *[F.hll_sketch_estimate(f"{name}_sketch").alias(name) for name in DISTINCT],
        "timed_orders",
        *[F.when(timed, F.kll_sketch_get_quantile_bigint("minutes_sketch", F.lit(q))).alias(n) for n, q in QUANTILES.items()],
    )


def merge_sketches(sketches: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Sketch rows of fewer or coarser keys: counts add up, sketches unite."""
    return sketches.groupBy(*keys).agg(
        F.sum("orders").alias("orders"),
        *[F.hll_union_agg(f"{name}_sketch").alias(f"{name}_sketch") for name in DISTINCT],
        F.sum("timed_orders").alias("timed_orders"),
        F.kll_merge_agg_bigint("minutes_sketch").alias("minutes_sketch"),
    )


def roll_up(sketches: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """(period, keys, orders, customers, restaurants, timed_orders, p50, p90) from daily sketches alone.

    ``period`` is a unit of date_trunc such as month. Without a timed order the quantiles are NULL.
    """
    start = F.date_trunc(period, "order_date").cast("date").alias("period")
    return _estimates(merge_sketches(sketches, [start, *keys]), ["period", *keys])


def roll_up_check(fct_orders: DataFrame, rolled: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """The exact counts next to whether the rolled-up ones are within their bounds.

    A count may be off by COUNT_BOUND of the exact one, a quantile by RANK_BOUND of the timed orders in rank.
    """
    groups = ["period", *keys]
    rows = fct_orders.withColumn("period", F.date_trunc(period, "order_date").cast("date"))
    told = rolled.select(
        *[F.col(g).alias(f"_{g}") for g in groups], *[F.col(n).alias(f"_{n}") for n in (*DISTINCT, *QUANTILES)]
    )
    same = F.lit(True)
    for g in groups:
        same = same & rows[g].eqNullSafe(told[f"_{g}"])
    minutes = F.when(F.col("is_delivered"), F.col("delivery_time_min"))
    timed = F.count(minutes)
    near = {}
    for n, q in QUANTILES.items():
        below, up_to = F.count_if(minutes < F.col(f"_{n}")) / timed, F.count_if(minutes <= F.col(f"_{n}")) / timed
        # A group without a timed order has no quantile, and none is right.
        near[n] = F.when(timed == 0, F.max(f"_{n}").isNull()).otherwise((below <= q + RANK_BOUND) & (up_to >= q - RANK_BOUND))
    exact = (
        rows.join(told, same, "left")
        .groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            *[F.countDistinct(c).alias(n) for n, c in DISTINCT.items()],
            timed.alias("timed_orders"),
            *[F.max(f"_{n}").alias(f"_{n}") for n in DISTINCT],
            *[near[n].alias(f"{n}_within") for n in QUANTILES],
        )
    )
    within = [within_bound(F.col(f"_{n}"), F.col(n)).alias(f"{n}_within") for n in DISTINCT]
    return exact.select(*groups, "orders", *DISTINCT, "timed_orders", *within, *[f"{n}_within" for n in QUANTILES])


def within_bound(estimate: Column, exact: Column, bound: float = COUNT_BOUND) -> Column:
    return F.coalesce(F.abs(estimate - exact) <= F.ceil(exact * bound), F.lit(False))
