"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes what its predecessor kept and is written before the next one reads it. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import language, line_dedup, packing, perplexity, simhash
from platter.llm.common import table, whole_text, written

# A text is rejected when less than this share of its n-grams belongs to the best language.
LEAST_LANGUAGE_SHARE = 0.2


def _digest() -> Column:
    return F.unhex(F.md5(whole_text("text")))


def _same_row(docs: DataFrame, name: Column, digest: Column) -> Column:
    return docs["doc_id"].eqNullSafe(name) & (_digest() == digest)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language. Texts without letters and texts in no learned language go.

    With nothing to learn from (no row with a text and a lang) no language can be told, and all rows go.
    """
    model = language.learn(docs)
    told = language.identify(docs, model).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE))
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is beyond the threshold of their language.

    Rows equal in id, language and text go together or not at all; an id alone takes no other text along.
    """
    verdicts = perplexity.classify(docs, table(spark, sf_dir, "labels"), with_digest=True)
    rejected = verdicts.filter("NOT kept").select(
        F.col("doc_id").alias("_rejected"), F.col("lang").alias("_lang"), F.col("text_md5").alias("_md5")
    ).distinct()
    same_lang = F.coalesce(docs["lang"], F.lit(perplexity.NO_LANGUAGE)) == rejected["_lang"]
    return docs.join(rejected, _same_row(docs, rejected["_rejected"], rejected["_md5"]) & same_lang, "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, each to its end; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, of several with it one text.

    Null ids come last. Rows equal in id and text are one document and go together or not at all.
    """
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _digest().alias("md5"))
    marked = simhash.similar_texts(docs.select(name.alias("doc_id"), "text"))
    dropped = marked.filter("NOT doc_id <=> component_id").select(
        F.col("doc_id.doc_id").alias("_dropped"), F.col("doc_id.md5").alias("_md5")
    ).distinct()
    return docs.join(dropped, _same_row(docs, dropped["_dropped"], dropped["_md5"]), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: one row per piece. Every row is a document of its own, null texts are only their end id.

    An empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# The stages learn models and link fingerprints, which SQL cannot express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
