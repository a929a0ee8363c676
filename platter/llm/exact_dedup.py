"""Exact duplicates by two-pass Bloom filtering, DataFrame functions only.

Pass 1 hashes every text to a few bits of a filter and keeps only the bits that
at least two rows have set. Pass 2 tests every row: a row with one unset bit is
certainly unique and passes straight through; only the possibly repeated rows
are shuffled by their digest and compared exactly. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import join_groups, ready, whole_text, written

# Bits of one broadcast filter at most: 64 MB. Beyond about 30 million rows more and more
# unique rows take the exact way too: their digests are shuffled, and the result is the same.
MAX_FILTER_BITS = 1 << 29
BITS_PER_ROW = 16
SEEDS = (11, 23)
_MAP_BITS = 32768  # bits of one bitmap of bitmap_construct_agg


def _bits(rows: int) -> int:
    return min(MAX_FILTER_BITS, max(_MAP_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))


def _slot(seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "_digest"), F.lit(bits))


def repeated_bits(digests: DataFrame, seed: int, bits: int) -> DataFrame:
    """Pass 1: bitmaps of the bits which two or more rows set; one row of 4 KB per 32,768 bits.

    Slots are counted inside every task first, so a digest that a third of all rows
    share sends one row per task.
    """
    slots = digests.select(_slot(seed, bits).alias("_slot")).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n"))
    return (
        slots.filter("_n > 1")
        .groupBy(F.expr("bitmap_bucket_number(_slot)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot))").alias("_bitmap"))
    )


def possibly_repeated(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 2: the rows with a flag `_maybe`; false means certainly unique."""
    flagged = digests.withColumn("_maybe", F.lit(True))
    for seed in SEEDS:
        filters = repeated_bits(digests, seed, bits)
        flagged = (
            flagged.withColumn("_slot", _slot(seed, bits))
            .withColumn("_bit", F.expr("CAST(bitmap_bit_position(_slot) AS INT)"))
            .withColumn("_bucket", F.expr("bitmap_bucket_number(_slot)"))
            .join(F.broadcast(filters), "_bucket", "left")
            .withColumn("_byte", F.conv(F.hex(F.expr("substring(_bitmap, _bit DIV 8 + 1, 1)")), 16, 10).cast("int"))
            .withColumn("_maybe", F.expr("_maybe AND coalesce(getbit(_byte, _bit % 8) = 1, false)"))
            .select(*digests.columns, "_maybe")
        )
    return flagged


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null texts count as empty.
    Null ids never win against others; a group of null ids only keeps them all, with
    a null keep_id. Rows that repeat the largest id of their text are the same
    document and are all kept. Other columns are ignored; an empty table gives an
    empty result.
    """
    ready(docs.sparkSession)
    digests = written(
        docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(whole_text(text_col), 256)).alias("_digest")), "digests"
    )
    total = digests.count()
    flagged = possibly_repeated(digests, _bits(total))
    unique = flagged.filter(~F.col("_maybe")).select("_id", "_digest", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"))
    repeated = flagged.filter("_maybe").select("_id", "_digest")
    groups = repeated.groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    exact = join_groups(repeated, groups, "_digest", "_size", total).select("_id", "_digest", "_keep", "_size")
    return unique.unionByName(exact).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without the copies that `mark_copies` drops.

    A row goes by its id and its text: other texts under the id of a copy stay, and a null id goes where its text has a row with an id.
    """
    dropped = mark_copies(docs, id_col, text_col).filter("NOT kept").select(
        F.col(id_col).alias("_dropped"), F.col("text_sha256").alias("_sha")
    ).distinct()
    same = docs[f"`{id_col}`"].eqNullSafe(dropped["_dropped"]) & (F.sha2(whole_text(text_col), 256) == dropped["_sha"])
    return docs.join(dropped, same, "left_anti")
