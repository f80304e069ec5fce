"""Token-set similarity of two texts, 0 to 100.

Texts are compared as sets of words: I in common, D1 and D2 the rest of each, sorted and joined. If one rest is empty
and I isn't, the similarity is 100; else it is the best of three edit ratios, of which two follow from lengths alone.
Everything but the longest common subsequence is built-in functions; that one runs in Arrow batches, and only for rows
that lengths can't decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tableproof.functions.text import word_set


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(LongType())
def _subsequence(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([-1 if a is None or b is None else subsequence(a, b) for a, b in zip(left, right, strict=True)], dtype="int64")


def scored(pairs: DataFrame, left: str, right: str, out: str = "similarity", least: float | None = None) -> DataFrame:
    """pairs with the similarity of two of their columns; with least, only rows that reach it."""
    packed = pairs.select(F.struct("*").alias("_row"), word_set(F.col(left)).alias("_a"), word_set(F.col(right)).alias("_b"))
    both = F.array_join(F.array_intersect("_a", "_b"), " ")
    packed = packed.select("_row", F.size("_a").alias("_na"), F.size("_b").alias("_nb"), F.length(both).alias("_s"), F.array_join(F.array_except("_a", "_b"), " ").alias("_x"), F.array_join(F.array_except("_b", "_a"), " ").alias("_y"))
    s, p, q = F.col("_s").cast("double"), F.length("_x").cast("double"), F.length("_y").cast("double")
    link = F.when(s > 0, 1.0).otherwise(0.0)
    known = F.when((F.col("_na") == 0) | (F.col("_nb") == 0), F.lit(0.0)).when((s > 0) & ((p == 0) | (q == 0)), F.lit(100.0))
    one_sided = F.when(s > 0, F.greatest(100 - 100 * (1 + p) / (2 * s + 1 + p), 100 - 100 * (1 + q) / (2 * s + 1 + q))).otherwise(F.lit(0.0))
    ratio = lambda indel: 100 - 100 * indel / (2 * s + 2 * link + p + q)
    packed = packed.withColumn("_known", known)
    if least is not None:
        # the edit distance is at least the difference of the lengths
        packed = packed.where(F.coalesce(F.col("_known"), F.greatest(one_sided, ratio(F.abs(p - q)))) >= least)
    open_ = F.col("_known").isNull()
    measured = packed.withColumn("_lcs", _subsequence(F.when(open_, F.col("_x")), F.when(open_, F.col("_y"))))
    value = F.when(open_, F.greatest(one_sided, ratio(p + q - 2 * F.col("_lcs").cast("double")))).otherwise(F.col("_known"))
    result = measured.select("_row", value.alias("_value"))
    if least is not None:
        result = result.where(F.col("_value") >= least)
    return result.select("_row.*", F.col("_value").alias(out))


def _ship() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
