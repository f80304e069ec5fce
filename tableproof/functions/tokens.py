"""Token-level expressions: stripping, missing values, numeric, date and boolean shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tokens that stand for a missing value (stripped, lower case).
NULL_WORDS = ("", "na", "n/a", "null", "none", "-", "--", "nan")
#: Boolean words, true ones first.
TRUE_WORDS = ("true", "yes", "y", "oui", "vrai")
FALSE_WORDS = ("false", "no", "n", "non", "faux")
#: Characters that numbers may carry without meaning.
CURRENCY = "$€£¥\u00a0 \t"
#: The shapes of tokens.
INTEGER = r"(?U)^[+-]?\d+$"
LEADING_ZERO = r"(?U)^[+-]?0\d+$"
FLOAT = r"(?U)^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
LOOSE_NUMBER = r"(?U)^[+-]?\d{1,3}(?:[ .,]\d{3})*(?:[.,]\d+)?$"
_TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
DATEISH = (
    rf"(?U)^(?:\d{{1,4}}[-/.]\d{{1,2}}[-/.]\d{{1,4}}(?:[ T]{_TIME})?"
    rf"|\d{{1,2}}[\s-]+[A-Za-zÀ-ÿ]{{3,}}\.?\s+\d{{2,4}}(?:[\s,]+{_TIME})?"
    rf"|[A-Za-zÀ-ÿ]{{3,}}\.?\s+\d{{1,2}},?\s+\d{{2,4}}(?:[\s,]+{_TIME})?)$"
)
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
#: Whole words in a column's name that promise no negative values.
NON_NEGATIVE_NAMES = ("qty", "quantity", "count", "counts", "age", "price", "amount", "total", "sum", "montant", "quantite", "quantité")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def null_like(c: Column) -> Column:
    """Whether a value is missing: null, blank or a word for it. Never null."""
    return F.coalesce(F.lower(strip(c)).isin(*NULL_WORDS), F.lit(True))


def without_currency(c: Column) -> Column:
    return F.translate(c, CURRENCY, "")


def bool_word(token: Column) -> Column:
    return F.lower(token).isin(*TRUE_WORDS, *FALSE_WORDS)


def clean_number(c: Column, thousands: str | None, decimal: str | None, currency: bool = True) -> Column:
    """A number's text with thousands separators gone and a dot for the decimal sign."""
    c = without_currency(c) if currency else c
    if thousands:
        c = F.replace(c, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        c = F.replace(c, F.lit(decimal), F.lit("."))
    return c


def to_double(token: Column) -> Column:
    """Double of a float literal, else null: casts alone would take "1d" or "inf" too."""
    return F.when(token.rlike(FLOAT), token.try_cast("double"))
