"""Text expressions: surfaces of cells and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableproof.functions.tokens import SPACE, null_like, strip

CASES = ("keep", "lower", "upper", "title")
#: Stands between the parts of a key; it counts as white space.
UNIT = "\u001f"


def compatible(c: Column) -> Column:
    """Unicode compatibility composition (NFKC); plain ASCII passes untouched."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def title(c: Column) -> Column:
    """Each run of letters with its first one in upper case, the others in lower."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def surface(c: Column, case: str = "keep") -> Column:
    if case not in CASES:
        raise ValueError(f"case is one of {CASES}, not {case!r}")
    clean = strip(F.regexp_replace(compatible(c), rf"(?U){SPACE}+", " "))
    return {"keep": lambda x: x, "lower": F.lower, "upper": F.upper, "title": title}[case](clean)


def key_part(c: Column) -> Column:
    words = F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " ")
    return F.when(null_like(c), F.lit("")).otherwise(strip(F.regexp_replace(words, rf"(?U){SPACE}+", " ")))


def row_key(columns: list[Column]) -> Column:
    return F.concat_ws(UNIT, *[key_part(c) for c in columns])


def word_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")))
