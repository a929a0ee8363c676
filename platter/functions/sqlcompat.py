"""Column helpers for warehouse semantics that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = T.DecimalType(38, 9)

# Unicode White_Space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Word boundaries of the warehouse INITCAP function.
INITCAP_DELIMITERS = r"""\s\[\](){}/|<>!?@"^#$&~_,.:;*%+\-"""


def trim_all(col: Column) -> Column:
    """TRIM that strips every Unicode white space, not only U+0020."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def not_blank(col: Column) -> Column:
    """Not NULL and holds at least one non-space character (stops at the first one)."""
    return col.isNotNull() & col.rlike(r"(?U)\S")


def safe_int(col: Column) -> Column:
    return col.try_cast("bigint")


def safe_numeric(df: DataFrame, name: str) -> Column:
    """NUMERIC cast; a column that already is a decimal keeps its narrower type."""
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return F.col(name)
    return F.col(name).try_cast(NUMERIC)


def extract_or_null(col: Column, pattern: str) -> Column:
    """REGEXP_EXTRACT that yields NULL, not '', when nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, 0), F.lit(""))


def last_comma_part(col: Column) -> Column:
    """What follows the last comma; the whole text when nothing does."""
    return trim_all(F.coalesce(F.nullif(F.substring_index(col, ",", -1), F.lit("")), col))


def initcap_words(col: Column) -> Column:
    """INITCAP that also starts a new word after punctuation such as '-'."""
    words = F.regexp_extract_all(
        F.lower(col), F.lit(f"[{INITCAP_DELIMITERS}]+|[^{INITCAP_DELIMITERS}]+"), F.lit(0)
    )
    capital = F.transform(words, lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(col.isNotNull(), F.array_join(capital, ""))


def share(numerator: Column, denominator: Column) -> Column:
    """SAFE_DIVIDE of two counts or amounts as NUMERIC; NULL when nothing to divide by."""
    return F.try_divide(numerator.cast(NUMERIC), denominator.cast("decimal(20,0)"))


def rounded_share(numerator: Column, denominator: Column, digits: int, scale: int = 1) -> Column:
    """round(scale * numerator / denominator, digits), half away from zero."""
    return F.round(share(numerator * F.lit(scale), denominator), digits)
