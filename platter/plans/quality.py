"""Data tests: every check returns the failing rows, so an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted order states.
ORDER_STATUSES = ("Delivered", "Cancelled", "Refunded")


def not_null_failures(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """(value, copies) of every value that occurs more than once; NULLs are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def relationship_failures(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """(value, occurrences) of child values without a parent.

    The child is reduced to its distinct values first, so a hot key joins as one row.
    """
    values = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    return values.join(parent.select(F.col(field).alias("value")).distinct(), "value", "left_anti")


def accepted_value_failures(df: DataFrame, column: str, accepted) -> DataFrame:
    """(value, occurrences) of every non-NULL value outside the accepted list."""
    return (
        df.filter(~F.col(column).isin(*accepted))
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def order_fact_violations(fct_orders: DataFrame, dim_customer: DataFrame) -> DataFrame:
    """(check_name, failures) of the four tests on the order fact."""
    checks = {
        "accepted_values_order_status": accepted_value_failures(fct_orders, "order_status", ORDER_STATUSES),
        "not_null_order_id": not_null_failures(fct_orders, "order_id"),
        "relationships_customer_id": relationship_failures(
            fct_orders, "customer_id", dim_customer, "customer_id"
        ),
        "unique_order_id": unique_failures(fct_orders, "order_id"),
    }
    return reduce(
        DataFrame.unionByName,
        [
            failing.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures")
            for name, failing in checks.items()
        ],
    )


def require(violations: DataFrame) -> None:
    """Stop the build when a check has failures (one small row per check is fetched)."""
    failed = {r["check_name"]: r["failures"] for r in violations.filter("failures > 0").collect()}
    if failed:
        raise ValueError(f"data tests failed: {failed}")


def id_set_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(id, side): 'missing' ids are expected but absent, 'extra' ones are present but not expected."""
    left = expected.select(F.col(key).alias("id")).distinct().withColumn("_e", F.lit(True))
    right = actual.select(F.col(key).alias("id")).distinct().withColumn("_a", F.lit(True))
    return (
        left.join(right, "id", "full_outer")
        .filter(F.col("_e").isNull() | F.col("_a").isNull())
        .select("id", F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("side"))
    )
