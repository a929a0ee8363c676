"""Landing tables derived from the generic star-schema test data.

Every table is a lazy DataFrame over the given Parquet files; nothing is
collected, numbered globally or sampled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(18,2)"

# Closing sentences that give the invented texts the vocabulary of
# food-delivery reviews.
REVIEW_PHRASES = (
    "Delivered right on time.",
    "The food was cold and the delivery was late.",
    "Great taste, fresh and delicious meal!",
    "Staff were rude and unhelpful.",
    "Good value for money.",
    "Packaging was poor, the box arrived open.",
    "Excellent service, friendly and helpful.",
    "Too expensive for such a bland dish.",
    "Nothing special, but nothing terrible either.",
    "My order was missing an item.",
    "Amazing food and quick delivery.",
    "Ordered again.",
)

# One question per query vector.
QUESTIONS = (
    "What do customers say about food quality?",
    "Why is the delivery late?",
    "How is the restaurant service?",
    "Which reviews have low ratings?",
    "Do customers praise value for money?",
    "What are the problems with packaging?",
    "Show reviews with high ratings",
    "What do unhappy customers complain about?",
    "Tell me about the place",
    "What is the best thing customers like?",
)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file footer once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _text(col: str) -> Column:
    return F.col(col).cast("string")


def raw_restaurant(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return suppliers.select(
        key.cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.when(key % 10 == 0, F.col("n_name"))
        .otherwise(F.concat(F.lit("Zone "), (key % 7).cast("string"), F.lit(","), F.col("n_name")))
        .alias("city"),
        F.when(key % 9 == 0, F.lit("--"))
        .otherwise(F.concat((1 + key % 4).cast("string"), F.lit("."), (key % 10).cast("string")))
        .alias("rating"),
        F.when(key % 6 == 0, F.lit("Too Few Ratings"))
        .otherwise(F.concat((10 * (1 + key % 20)).cast("string"), F.lit("+ ratings")))
        .alias("rating_count"),
        (100 + 50 * (key % 8)).cast("string").alias("cost"),
        F.concat(F.lit("Cuisine "), (key % 6).cast("string")).alias("cuisine"),
        F.concat(F.lit("LIC"), key.cast("string")).alias("lic_no"),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.upper("c_name"), F.lit("@MAIL.TEST")).alias("email"),
        F.when(key % 13 == 0, F.lit("")).otherwise((18 + key % 60).cast("string")).alias("Age"),
        F.when(key % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("Gender"),
        F.when(key % 3 == 0, F.lit("Married")).otherwise(F.lit("Single")).alias("Marital Status"),
        F.col("c_mktsegment").alias("Occupation"),
        F.when(F.col("c_acctbal") < 0, F.lit("No Income"))
        .when(F.col("c_acctbal") < 5000, F.lit("Below 5000"))
        .otherwise(F.lit("More than 5000"))
        .alias("Monthly Income"),
        F.lit("Graduate").alias("Educational Qualifications"),
        (1 + key % 6).cast("string").alias("Family size"),
    )


def raw_food(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("fd"), _text("p_partkey")).alias("f_id"),
        F.col("p_name").alias("item"),
        F.when(F.col("p_size") % 2 == 0, F.lit("veg")).otherwise(F.lit("non-veg")).alias("veg_or_non_veg"),
    )


def raw_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    key = F.col("p_partkey")
    return offered.join(table(spark, sf_dir, "part"), F.col("l_partkey") == key).select(
        F.concat(F.lit("mn"), _text("l_suppkey"), F.lit("_"), _text("l_partkey")).alias("menu_id"),
        _text("l_suppkey").alias("r_id"),
        F.concat(F.lit("fd"), _text("l_partkey")).alias("f_id"),
        F.concat(F.lit("Cuisine "), (F.col("l_suppkey") % 6).cast("string")).alias("cuisine"),
        F.when(key % 11 == 0, F.lit("0"))
        .when(key % 17 == 0, F.lit("n/a"))
        .otherwise(F.col("p_retailprice").cast(MONEY).cast("string"))
        .alias("price"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    baskets = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("r_id"),
            F.count(F.lit(1)).alias("items_count"),
            F.sum("l_quantity").cast("bigint").alias("sales_qty"),
        )
    )
    places = raw_restaurant(spark, sf_dir).select(
        F.col("id").cast("bigint").alias("place_id"),
        F.col("city").alias("restaurant_city"),
        "cuisine",
    )
    total = F.col("o_totalprice").cast(MONEY)
    delivered = F.col("o_orderstatus") == "F"
    joined = (
        table(spark, sf_dir, "orders")
        .join(baskets.hint("merge"), key == F.col("l_orderkey"), "left")  # fact to fact: no broadcast
        .join(places, F.col("r_id") == F.col("place_id"), "left")
    )
    return joined.select(
        key.alias("order_id"),
        F.expr("CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1' HOUR").alias("order_timestamp"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("user_id"),
        "r_id",
        "restaurant_city",
        "cuisine",
        "items_count",
        "sales_qty",
        total.alias("subtotal"),
        (key % 50).cast(MONEY).alias("discount"),
        F.lit(30).cast(MONEY).alias("delivery_fee"),
        F.lit(5).cast(MONEY).alias("gst"),
        (total - (key % 50) + F.lit(35)).cast(MONEY).alias("sales_amount"),
        F.lit("INR").alias("currency"),
        F.when(key % 29 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("payment_method"),
        F.when(delivered, F.lit("Delivered"))
        .when(F.col("o_orderstatus") == "O", F.lit("Cancelled"))
        .otherwise(F.lit("Refunded"))
        .alias("order_status"),
        F.when(delivered & (key % 7 != 0), 1 + key % 5).alias("customer_rating"),
        F.when(delivered, 15 + (key * 7) % 61).alias("delivery_time_min"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    # A content key instead of a global running number: no sort, no shuffle, the
    # same after a task is retried. Both halves stay below the prime.
    prime = F.lit(2147483647)
    line = (key % prime * 8 + F.col("l_linenumber")) % prime
    content = F.col("l_partkey") % prime * 65537 + F.col("l_suppkey") % prime * 257 + F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        (line * prime + content % prime).alias("order_item_id"),
        F.when(key % 101 == 0, key + F.lit(100000000)).otherwise(key).alias("order_id"),
        F.col("l_suppkey").alias("r_id"),
        F.concat(F.lit("fd"), _text("l_partkey")).alias("f_id"),
        (50 + F.col("l_partkey") % 450).cast(MONEY).alias("price"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("line_amount"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    phrases = F.array(*[F.lit(p) for p in REVIEW_PHRASES])
    ending = F.element_at(phrases, (F.col("n_chars") % len(REVIEW_PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        key.alias("review_id"),
        key.alias("order_id"),
        (key % 150).alias("user_id"),
        (key % 100).alias("restaurant_id"),
        (1 + key % 5).alias("rating"),
        F.when(key % 97 == 0, F.lit(None))
        .when(key % 89 == 0, F.lit("   "))
        .otherwise(F.concat("text", F.lit(" "), ending))
        .alias("comment"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 366).cast("int")).alias("review_date"),
    )


def review_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id")
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    versions = F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        table(spark, sf_dir, "labels")
        .withColumn("k", F.explode(versions))
        .select(
            key.cast("string").alias("review_id"),
            F.when(toxic, "negative").when(good, "positive").otherwise("neutral").alias("sentiment_label"),
            F.when(toxic, F.lit(-0.75)).when(good, F.lit(0.5)).otherwise(F.lit(0.0)).alias("sentiment_score"),
            F.when(key % 4 == 0, "food_quality")
            .when(key % 4 == 1, "delivery")
            .when(key % 4 == 2, "service")
            .otherwise("other")
            .alias("topic"),
            F.when(toxic, F.concat(F.lit("issue "), (key % 3).cast("string"))).alias("key_issue"),
            F.expr("TIMESTAMP '2024-06-01 00:00:00' + k * INTERVAL '1' HOUR").alias("processed_at"),
            F.concat(F.lit("model"), F.col("k").cast("string")).alias("model_used"),
        )
    )


BUILDERS = {
    "restaurant": raw_restaurant,
    "users": raw_users,
    "food": raw_food,
    "menu": raw_menu,
    "orders": raw_orders,
    "order_items": raw_order_items,
    "reviews": raw_reviews,
}


class Landing(Mapping):
    """The landing tables by name, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._built = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = BUILDERS[name](self._spark, self._dir)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


def review_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")


def query_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of the vectors carrying it."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.col("label").cast("bigint").alias("query_id"))
        .agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("embedding"))
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question behind each query vector."""
    texts = F.array(*[F.lit(q) for q in QUESTIONS])
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("query_id")).distinct()
    return labels.withColumn(
        "question", F.element_at(texts, (F.col("query_id") % len(QUESTIONS) + 1).cast("int"))
    )


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations, opened by one of the questions."""
    texts = F.array(*[F.lit(q) for q in QUESTIONS])
    opening = F.element_at(texts, ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select("conv_id", "turn", F.concat_ws(" ", opening, "text").alias("question"))
    )


# Extra openings of logged questions and the SQL that answered them.
LOG_QUESTIONS = (
    "Top 10 cities by GMV", "What is the average sentiment score?", "Which users order most, by age?",
    "Is the weather better on Netflix or YouTube?", "How many negative reviews are there?",
    "What was the share price of amazon?", "Show everything",
)
LOG_SQL = (
    "SELECT city FROM marts.mart_daily_city_revenue",
    "  with t AS (SELECT 1 AS x) SELECT x FROM t",
    "SELECT 1; SELECT 2",
    "DROP TABLE raw.reviews",
    "SELECT * FROM t WHERE 1 = 1 delete",
    "",
    "SELECT 1 EXPORT   DATA",
    "SELECT updated, created_at FROM t",
)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def full_question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question log with every third turn opened by one of the other questions."""
    log = question_log(spark, sf_dir)
    n = F.col("conv_id") * 7 + F.col("turn")
    other = F.concat_ws(" ", _pick(LOG_QUESTIONS, n), F.col("question"))
    return log.withColumn("question", F.when(F.pmod(n, F.lit(3)) == 0, other).otherwise(F.col("question")))


def sql_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged statement per question, with the question's text as its comment; some are empty."""
    statement = _pick(LOG_SQL, F.col("conv_id") * 5 + F.col("turn"))
    commented = F.concat(statement, F.lit(" -- "), F.col("question"))
    return question_log(spark, sf_dir).select("conv_id", "turn", F.when(statement == "", "").otherwise(commented).alias("sql"))


def route_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and actual route with seconds per logged question; its length decides what went wrong."""
    n = F.length("question")
    routes = ("sql", "rag", "hybrid")
    return question_log(spark, sf_dir).select(
        "conv_id",
        "turn",
        _pick(routes, F.col("conv_id")).alias("expected"),
        F.when(F.pmod(n, F.lit(7)) != 0, _pick(routes, F.col("conv_id") + F.when(n % 5 == 0, 1).otherwise(0))).alias(
            "actual"
        ),
        (1 + n % 9).alias("seconds"),
    )


def route_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw router answers that give the question as their reason, some broken in one of several ways."""
    n = F.col("conv_id") * 3 + F.col("turn")
    answers = (
        '{"route": "sql", "confidence": 0.9, "reason": @}',
        '{"route": " RAG ", "confidence": "0.5", "reason": @}',
        '{"route": "hybrid", "confidence": 1, "reason": @}',
        '{"route": "sql", "confidence": 0.7, "reason": [@]}',
        '{"route": "sql", "confidence": 0.7, "reason": 5}',
        '{"route": "other", "confidence": 0.9, "reason": "x"}',
        '{"route": "sql", "confidence": 1.5, "reason": "x"}',
        '{"route": "rag", "confidence": "high", "reason": "x"}',
        '{"route": "rag", "confidence": 0.4, "reason": "  "}',
        '{"confidence": 0.4, "reason": "x"}',
        "not json",
    )
    log = question_log(spark, sf_dir)
    in_json = F.to_json(F.struct(F.col("question").alias("r")))  # {"r":"..."}
    quoted = in_json.substr(F.lit(6), F.length(in_json) - 6)
    return log.select("conv_id", "turn", F.replace(_pick(answers, n), F.lit("@"), quoted).alias("response"))


MODELS = ("model-a", "model-b", "model-c", "model-d")


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested review ids per batch of 15 neighbouring ids."""
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.floor(F.col("doc_id") / 15).alias("batch_id"))
        .agg(F.array_sort(F.collect_list("doc_id")).alias("review_ids"))
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of four models per batch, broken in nine known ways.

    (batch_id, model, priority, seconds, raw); a failed request has no answer and
    no time.
    """
    key, p = F.col("doc_id"), F.col("priority")
    label = _pick(("positive", "neutral", "negative"), key * p)
    score = _pick(("0.5", "0.0", "-0.25", "1"), key * p)
    issue = F.when(key % 3 == 0, F.concat(F.lit('" issue '), (key % 7).cast("string"), F.lit(' "'))).otherwise(
        F.when(key % 3 == 1, F.lit('"  "')).otherwise(F.lit("null"))
    )
    item = F.concat(
        F.lit('{"review_id": "'), key.cast("string"), F.lit('", "sentiment_label": "'), label,
        F.lit('", "sentiment_score": '), score, F.lit(', "topic": "'),
        _pick(("food_quality", " delivery ", "service", "other"), key * p), F.lit('", "key_issue": '), issue,
        F.lit("}"),
    )
    asked = (
        table(spark, sf_dir, "documents")
        .select("doc_id")
        .withColumn("priority", F.explode(F.array(*[F.lit(i) for i in range(1, len(MODELS) + 1)])))
        .select(F.floor(key / 15).alias("batch_id"), "priority", F.struct(key.alias("id"), item.alias("json")).alias("x"))
        .groupBy("batch_id", "priority")
        .agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["json"]).alias("items"))
    )
    items, first = F.col("items"), F.col("items")[0]
    rest = F.slice(items, F.lit(2), F.size(items))

    def joined(*parts: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.concat(*parts), ", "), F.lit("]"))

    def with_first(changed: Column) -> Column:
        return joined(F.array(changed), rest)

    plain = joined(items)
    variants = [
        plain,
        F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        F.concat(F.lit("Here are the results: "), plain, F.lit(" Done.")),
        with_first(F.regexp_replace(first, '"sentiment_label": "[a-z]+"', '"sentiment_label": "mixed"')),
        with_first(F.regexp_replace(first, '"sentiment_score": [-0-9.]+', '"sentiment_score": 1.2')),
        with_first(F.regexp_replace(first, '"topic": "[a-z_ ]+", ', "")),
        joined(rest),
        joined(items, F.array(F.regexp_replace(first, '"review_id": "[0-9]+"', '"review_id": "-1"'))),
        joined(F.array(first), items),
        F.lit("not json"),
        F.lit(None).cast("string"),
        with_first(F.regexp_replace(first, '"sentiment_score": [-0-9.]+', '"sentiment_score": "0.5"')),
    ]
    n = F.pmod(F.col("batch_id") + 5 * (p - 1), F.lit(len(variants)))
    raw = F.lit(None).cast("string")
    for i, variant in enumerate(variants):
        raw = F.when(n == i, variant).otherwise(raw)
    return asked.select(
        "batch_id",
        _pick(MODELS, p - 1).alias("model"),
        "priority",
        F.when(n != 10, 1 + F.pmod(F.col("batch_id") * 7 + p * 3, F.lit(11))).alias("seconds"),
        raw.alias("raw"),
    )


def _answers(payload: str, label: str | None) -> str:
    """A valid answer to a request; without a label the rating decides."""
    items = []
    for r in json.loads(payload):
        rating = r.get("rating") or 3
        own = label or ("positive" if rating >= 4 else "negative" if rating <= 2 else "neutral")
        score = {"positive": 0.9, "negative": 0.1, "neutral": 0.5}[own]
        items.append(
            {"review_id": str(r["review_id"]), "sentiment_label": own, "sentiment_score": score, "topic": " other ", "key_issue": " "}
        )
    return json.dumps(items)


def steady_model(payloads: list[str]) -> list[str]:
    """A stand-in model that fails on every request whose first review id is a multiple of five."""
    if any(json.loads(p)[0]["review_id"] % 5 == 0 for p in payloads):
        raise RuntimeError("overloaded")
    return [_answers(p, None) for p in payloads]


def plain_model(payloads: list[str]) -> list[str]:
    """A stand-in model that always answers."""
    return [_answers(p, None) for p in payloads]


def spare_model(payloads: list[str]) -> list[str]:
    """A stand-in model that calls everything neutral and answers badly for multiples of seven."""
    return ["sorry" if json.loads(p)[0]["review_id"] % 7 == 0 else _answers(p, "neutral") for p in payloads]


def recovering_model(payloads: list[str], attempt: int) -> list[str]:
    """A stand-in model that gets better: by the first review id it fails twice on multiples of five, answers
    multiples of three badly at first and multiples of seven badly at all times."""
    first = [json.loads(p)[0]["review_id"] for p in payloads]
    if attempt <= 2 and any(i % 5 == 0 for i in first):
        raise RuntimeError("overloaded")
    return ["sorry" if i % 7 == 0 or (i % 3 == 0 and attempt == 1) else _answers(p, None) for i, p in zip(first, payloads)]


# Letters counted by the stand-in embedding.
LETTERS = "aeournst"


def letter_embedding(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for an embedding model: how often each of eight letters occurs."""
    return np.array([[t.lower().count(c) for c in LETTERS] for t in texts], dtype=np.float32).reshape(
        len(texts), len(LETTERS)
    )
