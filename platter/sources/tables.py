"""Table readers and writers: landing copies, CSV loads, embedding batches, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



# ------------------------------------------------------------------------- tables
def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder, in any store that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table, ordered by name."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in named.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("table_name")


# ---------------------------------------------------------------------------- CSV
def _csv_options(multi_line: bool) -> dict[str, object]:
    return {"header": True, "escape": '"', "nullValue": "", "multiLine": multi_line}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """A headed CSV with a given schema, never inferred by a second pass.

    Only texts with line breaks need ``multi_line``; it makes a file unsplittable.
    """
    return spark.read.csv(path, schema=schema, **_csv_options(multi_line))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(
        path,
        header=True,
        escape='"',
        nullValue="",
        emptyValue='""',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def load_csv(
    spark: SparkSession, csv_path: str, table_path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """Replace a landing table by a CSV; partitions take the place of upload chunks."""
    replace_table(read_csv(spark, csv_path, schema, multi_line), table_path)
    return spark.read.parquet(table_path)


def coerce_price(menu: DataFrame) -> DataFrame:
    """Menu rows with a numeric price; what is not a number becomes NULL."""
    return menu.withColumn("price", F.col("price").try_cast("double"))


def append_csv_once(
    spark: SparkSession, csv_dir: str, table_path: str, checkpoint: str, schema: T.StructType | str
) -> DataFrame:
    """Append menu files that were not loaded before.

    The stream's checkpoint remembers finished files, so a rerun resumes after the
    last one and adds nothing twice.
    """
    files = spark.readStream.csv(csv_dir, schema=schema, **_csv_options(False))
    (
        coerce_price(files)
        .writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(table_path)


# --------------------------------------------------------------- embedding batches
def write_embedding_batches(df: DataFrame, path: str, rows_per_file: int = 5000) -> None:
    """Parquet batches of at most ``rows_per_file`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_embedding_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches as one table, with the file each row came from and its position in it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).select(
        "*",
        F.col("_metadata.file_name").alias("batch_file"),
        F.col("_metadata.row_index").alias("batch_position"),
    )


def embedding_batch_scan(batches: DataFrame) -> DataFrame:
    """Only what re-embedding needs; the old vectors are never read."""
    return batches.select("review_id", "comment")


# ------------------------------------------------------------------------- lookups
def lookup_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key, as a string, is in the id table. Spark decides whether the ids are broadcast."""
    wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_wanted")).distinct()
    return df.join(wanted, F.col(key).cast("string") == F.col("_wanted"), "left_semi")


def parse_review_dates(df: DataFrame, column: str = "review_date") -> DataFrame:
    """Lenient date parse: what is not a date becomes NULL."""
    return df.withColumn(column, F.col(column).cast("string").try_cast("date"))
