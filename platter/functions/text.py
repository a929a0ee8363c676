"""Text normalisation, token sets, term families and review patterns as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A regular expression class both Java and RE2 read the same way: what Python's
# \s matches in text.
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"

# ---------------------------------------------------------------------------
# Evidence term families. Defaults; every function takes its own.
# ---------------------------------------------------------------------------
TERM_FAMILIES: dict[str, tuple[str, ...]] = {
    "food": (
        "food", "taste", "tasty", "delicious", "flavor", "flavour", "fresh", "freshness", "meal", "dish",
        "cuisine", "cooked", "cooking", "bland", "stale", "cold", "hot", "spicy", "authentic", "yummy",
    ),
    "delivery": (
        "delivery", "delivered", "arrived", "arrival", "late", "delayed", "delay", "partner", "courier",
        "quick", "fast", "slow", "time",
    ),
    "service": (
        "service", "staff", "waiter", "hospitality", "restaurant", "manager", "helpful", "rude", "friendly",
        "unhelpful",
    ),
    "price": (
        "price", "pricing", "value", "cost", "cheap", "expensive", "affordable", "worth", "money", "pricey",
    ),
    "packaging": ("packaging", "package", "packed", "box", "container", "pack", "eco"),
    "positive": (
        "good", "great", "excellent", "amazing", "delicious", "tasty", "fresh", "helpful", "polite",
        "friendly", "perfect", "perfectly", "best", "love", "loved", "fast", "quick", "value", "worth",
        "satisfied",
    ),
    "negative": (
        "bad", "terrible", "worst", "poor", "rude", "late", "delayed", "delay", "problem", "problems",
        "issue", "issues", "complaint", "complaints", "wrong", "missing", "cold", "stale", "bland",
        "tasteless", "dropped", "never", "unhelpful", "slow",
    ),
}

# ---------------------------------------------------------------------------
# Phrases that reveal what a question asks about (substring match
# on the normalised question). "low-rated" and "5-star" can never match because
# normalising removes '-'; they are kept because the table is part of the rule.
# ---------------------------------------------------------------------------
INTENT_PHRASES: dict[str, tuple[str, ...]] = {
    "rating_low": (
        "low rating", "low ratings", "poor rating", "poor ratings", "bad rating", "bad ratings", "low rated",
        "low-rated",
    ),
    "rating_high": (
        "high rating", "high ratings", "high rated", "high-rated", "good rating", "good ratings", "top rated",
        "top-rated", "5 star", "5-star",
    ),
    "food": (
        "food", "taste", "tasty", "flavor", "flavour", "quality", "fresh", "freshness", "meal", "dish", "cuisine",
    ),
    "delivery": (
        "delivery", "delivered", "delivery partner", "arrived", "late", "delayed", "delivery time",
    ),
    "service": ("service", "staff", "waiter", "hospitality", "restaurant service", "customer service"),
    "price": (
        "price", "pricing", "value", "value for money", "cost", "cheap", "expensive", "affordable", "worth",
        "money",
    ),
    "packaging": ("packaging", "package", "packed", "box", "container"),
    "positive": ("positive", "good", "best", "like", "liked", "praise", "satisfied", "happy"),
    "negative": (
        "negative", "bad", "worst", "dislike", "disliked", "complaint", "complaints", "complain", "rude", "poor",
    ),
    "problem": (
        "problem", "problems", "issue", "issues", "complaint", "complaints", "complain", "wrong", "missing",
        "never arrived",
    ),
}

ASPECTS = ("food", "delivery", "service", "price", "packaging")


def normalize_text(col: Column) -> Column:
    """Lower case, runs of white space to one blank, punctuation removed, ends stripped.

    White space is collapsed before punctuation goes, so "a - b" keeps two blanks.
    """
    lowered = F.lower(F.coalesce(col, F.lit("")))
    # Single blanks, the usual case, are left alone instead of being replaced by themselves.
    collapsed = F.regexp_replace(lowered, f"[{SPACE_CLASS}&&[^ ]][{SPACE_CLASS}]*| [{SPACE_CLASS}]+", " ")
    return F.btrim(F.regexp_replace(F.btrim(collapsed, F.lit(" ")), r"[^\p{L}\p{N}_ ]+", ""), F.lit(" "))


def tokens(normalized: Column) -> Column:
    """Distinct tokens of an already normalised text; empty array for an empty text."""
    return F.array_remove(F.array_distinct(F.split(normalized, " ")), "")


def jaccard_of(common: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity by the number of common tokens and both sizes; both empty 1.0, one empty 0.0."""
    union = left + right - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two distinct-token arrays; both empty 1.0, one empty 0.0."""
    return jaccard_of(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def _terms(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches_terms(token_array: Column, values) -> Column:
    return F.arrays_overlap(token_array, _terms(values))


def review_pattern(token_array: Column, families: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of all matching families, sorted and joined with a bar; 'other' when none."""
    families = families or TERM_FAMILIES
    # The long token array is searched once; the families only see the few terms found.
    known = F.array_intersect(token_array, _terms(sorted({t for terms in families.values() for t in terms})))
    names = F.transform(
        F.array(known),
        lambda found: F.concat_ws("|", *[F.when(matches_terms(found, families[n]), F.lit(n)) for n in sorted(families)]),
    )[0]
    return F.coalesce(F.nullif(names, F.lit("")), F.lit("other"))


def _any_phrase(question: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | question.contains(phrase)
    return found


def intent_flags(normalized_question: Column) -> dict[str, Column]:
    """One boolean column per intent, plus 'general' when nothing else was found."""
    flags = {name: _any_phrase(normalized_question, phrases) for name, phrases in INTENT_PHRASES.items()}
    anything = F.lit(False)
    for flag in flags.values():
        anything = anything | flag
    return {**flags, "general": ~anything}


def requested_terms(flag: dict[str, Column], families: dict[str, tuple[str, ...]] | None = None) -> Column:
    """All terms a question asks for; an empty array means no term constraint."""
    families = families or TERM_FAMILIES
    wanted = {name: flag[name] for name in ASPECTS}
    wanted["positive"] = flag["positive"] & ~flag["negative"]
    wanted["negative"] = flag["negative"] | flag["problem"]
    none = F.lit([]).cast("array<string>")
    return F.array_distinct(
        F.concat(*[F.when(on, _terms(families[name])).otherwise(none) for name, on in wanted.items()])
    )
