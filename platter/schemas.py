"""Typed schemas of the landing tables, the enrichment table and the model response."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from platter.functions.sqlcompat import NUMERIC

_S, _L, _TS, _D = T.StringType(), T.LongType(), T.TimestampType(), T.DateType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


# Column names and types of the landing tables as declared.
RAW_TABLES: dict[str, T.StructType] = {
    "restaurant": _schema(
        ("_idx", _S), ("id", _S), ("name", _S), ("city", _S), ("rating", _S), ("rating_count", _S), ("cost", _S),
        ("cuisine", _S), ("lic_no", _S), ("link", _S), ("address", _S), ("menu", _S),
    ),
    "users": _schema(
        ("_idx", _S), ("user_id", _S), ("name", _S), ("email", _S), ("password", _S), ("Age", _S), ("Gender", _S),
        ("Marital Status", _S), ("Occupation", _S), ("Monthly Income", _S), ("Educational Qualifications", _S),
        ("Family size", _S),
    ),
    "food": _schema(("_idx", _S), ("f_id", _S), ("item", _S), ("veg_or_non_veg", _S)),
    "menu": _schema(("_idx", _S), ("menu_id", _S), ("r_id", _S), ("f_id", _S), ("cuisine", _S), ("price", _S)),
    "orders": _schema(
        ("order_id", _L), ("order_timestamp", _TS), ("order_date", _D), ("user_id", _L), ("r_id", _L),
        ("restaurant_city", _S), ("cuisine", _S), ("items_count", _L), ("sales_qty", _L), ("subtotal", NUMERIC),
        ("discount", NUMERIC), ("delivery_fee", NUMERIC), ("gst", NUMERIC), ("sales_amount", NUMERIC),
        ("currency", _S), ("payment_method", _S), ("order_status", _S), ("customer_rating", NUMERIC),
        ("delivery_time_min", _L),
    ),
    "order_items": _schema(
        ("order_item_id", _L), ("order_id", _L), ("r_id", _L), ("f_id", _S), ("price", NUMERIC), ("quantity", _L),
        ("line_amount", NUMERIC),
    ),
    "reviews": _schema(
        ("review_id", _L), ("order_id", _L), ("user_id", _L), ("restaurant_id", _L), ("rating", _L),
        ("comment", _S), ("review_date", _D),
    ),
}

REVIEW_ENRICHED = T.StructType(
    [
        T.StructField("review_id", _S, False),
        T.StructField("sentiment_label", _S, True),
        T.StructField("sentiment_score", T.DoubleType(), True),
        T.StructField("topic", _S, True),
        T.StructField("key_issue", _S, True),
        T.StructField("processed_at", _TS, True),
        T.StructField("model_used", _S, True),
    ]
)

LAYERS = ("raw", "staging", "marts", "snapshots", "ai")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A landing table without rows, typed as declared."""
    return spark.createDataFrame([], RAW_TABLES[name])


def describe_tables(spark: SparkSession) -> DataFrame:
    """(table_name, position, column_name, data_type) of every landing table."""
    rows = [
        (table, i, f.name, f.dataType.simpleString())
        for table, schema in RAW_TABLES.items()
        for i, f in enumerate(schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
