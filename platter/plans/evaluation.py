"""Question rules, route validation and evaluation reports over question and response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C
from platter.functions import text as X

# ---------------------------------------------------------------------------
# Category words in rule order; the first category with a hit wins.
# ---------------------------------------------------------------------------
QUESTION_CATEGORIES: dict[str, tuple[str, ...]] = {
    "Review analytics": (
        "sentiment", "positive review", "negative review", "neutral review", "complaint", "complaints",
        "review topic", "review topics", "key issue", "issues", "feedback",
    ),
    "Delivery analytics": ("delivery", "late", "p50", "p90", "sla"),
    "Restaurant analytics": ("restaurant", "restaurants", "cuisine"),
    "Customer analytics": ("customer", "customers", "user", "users", "age", "gender"),
    "Order/revenue analytics": ("gmv", "revenue", "sales", "order", "orders"),
}
OTHER_CATEGORY = "General analytics"

# Terms of other domains.
EXTERNAL_TERMS = (
    "amazon", "myntra", "flipkart", "netflix", "youtube", "instagram", "facebook", "prime video", "hotstar",
    "spotify", "lg tv", "samsung tv", "iphone", "ipad", "playstation", "xbox", "weather", "temperature",
    "stock market", "share price", "football", "cricket", "tennis", "politics", "president", "prime minister",
    "election",
)

# Words a read-only statement may not hold.
FORBIDDEN_SQL = (
    r"\bDROP\b", r"\bDELETE\b", r"\bTRUNCATE\b", r"\bALTER\b", r"\bUPDATE\b", r"\bINSERT\b", r"\bCREATE\b",
    r"\bREPLACE\b", r"\bMERGE\b", r"\bGRANT\b", r"\bREVOKE\b", r"\bCALL\b", r"\bEXPORT\s+DATA\b",
)
EMPTY_SQL = "SQL query is empty."
NOT_A_QUERY = "Only SELECT/WITH queries are allowed."
SEVERAL_STATEMENTS = "Multiple SQL statements are not allowed."
FORBIDDEN_SQL_REASON = "Forbidden SQL operation detected: "

# Routes and the fallback.
ROUTES = ("sql", "rag", "hybrid")
FALLBACK_ROUTE = "sql"
FALLBACK_REASON = "Semantic router unavailable; using SQL as the application fallback."


def _holds_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def question_category(questions: DataFrame) -> DataFrame:
    lowered = F.lower("question")
    label = F.lit(OTHER_CATEGORY)
    for name, words in reversed(QUESTION_CATEGORIES.items()):
        label = F.when(_holds_any(lowered, words), F.lit(name)).otherwise(label)
    return questions.withColumn("category", label)


def domain_flag(questions: DataFrame) -> DataFrame:
    """Adds the matched terms of other domains (in list order) and whether there are any."""
    normalized = F.regexp_replace(F.lower(C.trim_all(F.col("question"))), f"[{X.SPACE_CLASS}]+", " ")
    matched = F.array_compact(
        F.array(*[F.when(normalized.contains(term), F.lit(term)) for term in EXTERNAL_TERMS])
    )
    return questions.withColumn("matched_terms", F.array_join(matched, "|")).withColumn(
        "external", F.col("matched_terms") != ""
    )


def sql_audit(log: DataFrame, column: str = "sql") -> DataFrame:
    """Adds whether a logged statement is a single read-only query and the first reason why not."""
    text = C.trim_all(F.col(column))
    reason = F.lit(None).cast("string")
    for pattern in reversed(FORBIDDEN_SQL):
        reason = F.when(text.rlike(f"(?i){pattern}"), F.lit(FORBIDDEN_SQL_REASON + pattern)).otherwise(reason)
    reason = (
        F.when(F.col(column).isNull() | (F.col(column) == ""), F.lit(EMPTY_SQL))
        .when(~text.rlike(r"(?i)\A(SELECT|WITH)\b"), F.lit(NOT_A_QUERY))
        .when(text.contains(";"), F.lit(SEVERAL_STATEMENTS))
        .otherwise(reason)
    )
    return log.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def route_validate(responses: DataFrame, column: str = "response") -> DataFrame:
    """Route, confidence and reason of each JSON answer, or the fallback when any of them is invalid."""
    parsed = F.from_json(F.col(column), "route string, confidence string, reason variant")
    route = F.lower(C.trim_all(parsed["route"]))
    confidence = parsed["confidence"].try_cast("double")
    # A reason that is no text (a number, an object) makes the answer invalid.
    is_text = F.schema_of_variant(parsed["reason"]) == "STRING"
    reason = F.when(is_text, C.trim_all(F.try_variant_get(parsed["reason"], "$", "string")))
    usable = F.coalesce(
        route.isin(*ROUTES) & confidence.between(0.0, 1.0) & (reason != ""),
        F.lit(False),
    )
    return responses.select(
        *[c for c in responses.columns if c != column],
        F.when(usable, route).otherwise(F.lit(FALLBACK_ROUTE)).alias("route"),
        F.when(usable, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(usable, reason).otherwise(F.lit(FALLBACK_REASON)).alias("reason"),
        (~usable).alias("fallback"),
    )


def route_confusion(cases: DataFrame) -> DataFrame:
    """Expected routes against actual ones: one row per expected route, one column per actual."""
    return (
        cases.withColumn("_actual", F.coalesce("actual", F.lit("none")))
        .groupBy("expected")
        .pivot("_actual", [*ROUTES, "none"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .select("expected", *[F.col(r).alias(f"as_{r}") for r in (*ROUTES, "none")])
    )


def route_accuracy(cases: DataFrame) -> DataFrame:
    """One row: cases, passed, failed, accuracy percent, total and mean seconds."""
    passed = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.sum("seconds").alias("total_seconds"),
    ).select(
        "*",
        C.rounded_share(F.col("passed"), F.col("cases"), 2, 100).alias("accuracy_percent"),
        C.rounded_share(F.col("total_seconds"), F.col("cases"), 4).alias("avg_seconds"),
    )
