"""Column helpers: casts, trimming, capitals, rounding, text normalisation, intents."""

import re
import unicodedata
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platter.functions import sqlcompat as C
from platter.functions import text as X
from platter.functions import vector as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value, want", [("12", 12), (" 12 ", 12), ("12.5", None), ("", None), ("--", None), (None, None)])
def test_safe_int(spark, value, want):
    assert one(spark, C.safe_int, value) == want


@pytest.mark.parametrize(
    "value, want",
    [("Andheri,Mumbai", "Mumbai"), ("Zone 1, Goa ", "Goa"), ("Mumbai,", "Mumbai,"), ("Pune", "Pune"), (None, None),
     ("a,\tDelhi ", "Delhi"), ("a,b\n", "b")],
)
def test_last_comma_part(spark, value, want):
    assert one(spark, C.last_comma_part, value) == want


@pytest.mark.parametrize(
    "value, want", [("non-veg", "Non-Veg"), ("VEG", "Veg"), ("a b_c", "A B_C"), ("é-ü", "É-Ü"), ("", ""), (None, None)]
)
def test_initcap(spark, value, want):
    assert one(spark, C.initcap_words, value) == want


@pytest.mark.parametrize("value, want", [("\t x  ", True), ("\t \n", False), ("", False), (None, False)])
def test_not_blank(spark, value, want):
    assert one(spark, C.not_blank, value) is want


@pytest.mark.parametrize(
    "num, den, want", [(1, 8, "0.13"), (-1, 8, "-0.13"), (201, 200, "1.01"), (1, 0, None), (None, 3, None), (2, 3, "0.67")]
)
def test_rounded_share(spark, num, den, want):
    df = spark.createDataFrame([(num, den)], "n bigint, d bigint")
    got = df.select(C.rounded_share(F.col("n"), F.col("d"), 2)).first()[0]
    assert got == (None if want is None else Decimal(want))


def plain_normalize(text):
    """What the normalisation must give, restated with Python's own Unicode rules."""
    words = re.sub(r"\s+", " ", text.lower().strip())
    return "".join(c for c in words if c.isalnum() or c == "_" or c.isspace()).strip()


@pytest.mark.parametrize(
    "value", ["a - b", "é!", "  Tab\tand\nline  ", "", "!!!", "snake_case 12½", "नमस्ते दुनिया", "\x1cx\x1fy", "A B", "…"]
)
def test_normalize_text(spark, value):
    assert one(spark, X.normalize_text, value) == plain_normalize(value)


def test_normalize_null(spark):
    assert one(spark, X.normalize_text, None) == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.text(st.characters(min_codepoint=9, max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn", "Co")), max_size=40),
        min_size=1, max_size=40,
    )
)
def test_normalize_random(spark, texts):
    # Letters whose lower case depends on the Unicode version or context are left out.
    plain = [t for t in texts if t.lower() == "".join(c.lower() for c in t) and "İ" not in t and "Σ" not in t]
    plain = [t for t in plain if all(unicodedata.category(c) != "Lu" or len(c.lower()) == 1 for c in t)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, v string")
    got = {r["i"]: r["n"] for r in df.select("i", X.normalize_text(F.col("v")).alias("n")).collect()}
    for i, t in enumerate(plain):
        assert got[i] == plain_normalize(t), repr(t)


@pytest.mark.parametrize(
    "a, b, want", [("", "", 1.0), ("x", "", 0.0), ("a b c", "b c d", 0.5), ("a a b", "b a", 1.0)]
)
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b")))).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Late.", "delivery|negative"),
        ("Amazing food!!! Fast delivery and excellent packaging.", "delivery|food|packaging|positive"),
        ("Food was okay. Nothing special, but nothing terrible either.", "food|negative"),
        ("qwerty", "other"),
        ("", "other"),
        (None, "other"),
    ],
)
def test_review_pattern(spark, text, want):
    assert one(spark, lambda c: X.review_pattern(X.tokens(X.normalize_text(c))), text) == want


@pytest.mark.parametrize(
    "question, wanted",
    [
        ("What about low-rated places?", {"general"}),  # '-' is removed, so the phrase cannot match
        ("5-star reviews", {"general"}),
        ("Reviews with low ratings", {"rating_low"}),
        ("I dislike this", {"positive", "negative"}),  # 'like' is part of 'dislike'
        ("An empty plate", {"delivery"}),  # 'late' is part of 'plate'
        ("Tell me more", {"general"}),
        ("Value for money?", {"price"}),
    ],
)
def test_intents(spark, question, wanted):
    df = spark.createDataFrame([(question,)], "question string")
    flags = X.intent_flags(X.normalize_text(F.col("question")))
    row = df.select(*[c.alias(n) for n, c in flags.items()]).first()
    assert {n for n in flags if row[n]} == wanted


def test_vector_columns(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],)], "v array<float>")
    got = df.select(V.norm(F.col("v")), V.unit(F.col("v")), V.all_finite(F.col("v"))).collect()
    assert got[0][0] == 5.0 and got[0][1] == pytest.approx([0.6, 0.8]) and got[0][2]
    assert got[1][1] is None
    assert not got[2][2]
