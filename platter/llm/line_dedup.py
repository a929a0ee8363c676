"""Repeated runs of lines, found by prefix doubling over line ids; DataFrame functions only.

The lines of all documents, in id order, are one long sequence. Lines that occur once can be in
no repeated run and leave at once. The rank of a suffix at length 2^k is the first place with the same
2^k lines; ranks at 2^(k+1) come from pairs of ranks, and suffixes that are alone in their class leave.
A run counts if it has at least `min_words` words. At every place the shortest run with so many words and the
shortest ones that end further on are compared through two overlapping ranks, which gives the intervals of suffixes whose
longest common prefix reaches that far. All but the first of an interval are later copies, and their lines are deleted.
Any line of a maximal repeated run is in such a shortest run of it, so the maximal run goes as a whole, however long it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import join_groups, ready, whole_text, written
from platter.operators.ranking import numbered

MIN_WORDS = 50
WORD = r"[^ \t-\r]+"


def _row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text. Rows equal in both are one document."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(name, F.lit("\0"), whole_text(text_col))))


def _lines(text_col: str) -> Column:
    return F.split(whole_text(text_col), "\n", -1)


def _worded(lines: Column) -> Column:
    """The lines that have words: place in the text, line id, number of words."""
    numbered_lines = F.transform(
        lines,
        lambda line, place: F.struct(
            place.alias("place"), F.unhex(F.md5(line)).alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words")
        ),
    )
    return F.filter(numbered_lines, lambda x: x["words"] > 0)


def _reach(words: Column, start: Column, min_words: int) -> Column:
    """How many lines from `start` it takes to reach `min_words` words; null if the text ends before."""
    enough = F.aggregate(
        F.slice(words, start + 1, min_words),
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
        lambda got, w: F.when(got["words"] >= min_words, got).otherwise(
            F.struct((got["words"] + w).alias("words"), (got["lines"] + 1).alias("lines"))
        ),
    )
    return F.when(enough["words"] >= min_words, enough["lines"])


def _longest(words: Column, start: Column, min_words: int) -> Column:
    """How many lines from `start` a run can have that has fewer than `min_words` words without its first line."""
    onward = F.aggregate(
        F.slice(words, start + 2, min_words),
        F.struct(F.lit(0).alias("words"), F.lit(1).alias("lines")),
        lambda got, w: F.struct(
            (got["words"] + w).alias("words"), F.when(got["words"] + w < min_words, got["lines"] + 1).otherwise(got["lines"]).alias("lines")
        ),
    )
    return onward["lines"]


def line_table(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, seq, line, reach, longest): the lines with words, seq counting them within a document.

    Runs of reach to longest lines are compared from each: the shortest run with enough words that starts at the
    line, and all longer ones that would not have enough without it, which are the shortest that end at some line.
    """
    arrays = docs.select(
        F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_key"), _worded(_lines(text_col)).alias("_lines")
    ).withColumn("_words", F.col("_lines.words"))
    rows = F.transform(
        "_lines",
        lambda x, seq: F.struct(
            x["line"].alias("line"),
            _reach(F.col("_words"), seq, min_words).alias("reach"),
            _longest(F.col("_words"), seq, min_words).alias("longest"),
        ),
    )
    return arrays.select("_id", "_key", F.posexplode(rows).alias("seq", "_row")).select(
        "_id", "_key", "seq", "_row.line", "_row.reach", F.greatest("_row.reach", "_row.longest").alias("longest")
    )


def _first_places(rows: DataFrame, key: list[str], total: int) -> DataFrame:
    """The rows whose key occurs more than once, with `first`, the smallest place that has it."""
    keyed = rows.withColumn("_class", F.struct(*key))
    classes = keyed.groupBy("_class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return join_groups(keyed, classes, "_class", "_n", total).drop("_class", "_n")


def later_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(_key, seq, reach) of every run that has an earlier copy."""
    total = lines.count()
    repeated = lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # Rows equal in id and text are one document, so each of its lines counts once.
    active = join_groups(lines, repeated, "line", "_n", total).drop("_n").dropDuplicates(["_key", "seq"])
    # Places in the one long sequence; a step of one in both place and seq is a step within a document.
    suffixes = written(numbered(active, ["_id", "_key", "seq"], "at").drop("_id"), "suffixes")
    ranks = _first_places(suffixes.select("at", "_key", "seq", "line", "reach", "longest"), ["line"], total).withColumnRenamed("first", "rank").drop("line")
    found, length = [], 1
    while True:
        ranks = written(ranks, "ranks")
        # Runs of length .. 2 * length - 1 lines: equal if their first and their last `length` lines are.
        due = ranks.filter((F.col("longest") >= length) & (F.col("reach") < 2 * length)).withColumn(
            "reach", F.explode(F.sequence(F.greatest("reach", F.lit(length)), F.least("longest", F.lit(2 * length - 1))))
        )
        tail = ranks.select(F.col("at").alias("_tail_at"), F.col("_key").alias("_tail_key"), F.col("seq").alias("_tail_seq"), F.col("rank").alias("tail"))
        step = F.col("reach") - length
        runs = due.join(
            tail,
            (F.col("_tail_at") == F.col("at") + step) & (F.col("_tail_key") == F.col("_key")) & (F.col("_tail_seq") == F.col("seq") + step),
        )
        copies = _first_places(runs.select("at", "_key", "seq", "reach", "rank", "tail"), ["reach", "rank", "tail"], total)
        # Written at once: the plans of all rounds together are too much for the driver.
        found.append(written(copies.filter("at > first").select("_key", "seq", "reach"), "copies"))
        if 2 * length > min_words:
            return reduce(DataFrame.unionByName, found)
        onward = ranks.select(
            (F.col("at") - length).alias("_at"), F.col("_key").alias("_next_key"), (F.col("seq") - length).alias("_seq"), F.col("rank").alias("next")
        )
        pairs = ranks.join(
            onward, (F.col("_at") == F.col("at")) & (F.col("_next_key") == F.col("_key")) & (F.col("_seq") == F.col("seq"))
        ).select("at", "_key", "seq", "reach", "longest", "rank", "next")
        ranks = (
            _first_places(pairs, ["rank", "next"], total)
            .select("at", "_key", "seq", "reach", "longest", F.col("first").alias("rank"))
        )
        length *= 2


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with later copies of repeated line runs deleted from the text.

    Adds n_lines and n_deleted, in place of columns of these names. A run is repeated if the same
    lines, with at least `min_words` words in all, occur earlier: in a document with a smaller id or
    further up in the same one. It is deleted to its end. Lines without words are no part of a run and stay. Null texts
    stay null, with no line; an empty text has one line. Null ids come first; rows equal in id and text are one document
    and get the same result. A document whose lines all go keeps its row, with an empty text. An empty
    table gives an empty one with the same columns.
    """
    ready(docs.sparkSession)
    lines = written(line_table(docs, min_words, id_col, text_col), "lines")
    gone = (
        later_copies(lines, min_words)
        .select("_key", F.explode(F.sequence("seq", F.col("seq") + F.col("reach") - 1)).alias("_gone"))
        .groupBy("_key")
        .agg(F.collect_set("_gone").alias("_gone"))
        .withColumnRenamed("_key", "_gone_key")
    )
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    # The given columns travel in one struct, so that their names can't clash with those used here.
    given = docs.select(
        F.struct(*columns).alias("_row"), F.col(text_col).alias("_text"), _row_key(id_col, text_col).alias("_key")
    )
    parts = given.join(gone, given["_key"] == gone["_gone_key"], "left").withColumn("_all", _lines("_text"))
    # The places of the lines with words, for the documents that lose some.
    worded = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda place: F.get("_all", place).rlike(WORD))
    places = F.when(F.col("_gone").isNotNull(), worded)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.transform("_gone", lambda seq: F.get("_places", seq)))
    cleaned = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(kept, lambda place: F.get("_all", place)), "\n")
    )
    return parts.withColumn("_places", places).select(
        *[cleaned.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_all")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_deleted"),
    )
