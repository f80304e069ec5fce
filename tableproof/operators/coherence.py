"""Coherence checks: an open list of functions (context) -> (ledger or None, warnings or None)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import tokens as t
from tableproof.operators import dates
from tableproof.operators.ledger import WARNINGS, change, empty, warning
from tableproof.plans.cells import cells, columns_of, dictionary


@dataclass
class Context:
    """What checks look at. profiles: the rows of the profile table, a column each; occupied: ledger of taken cells."""

    df: DataFrame
    profiles: list
    values: DataFrame
    occupied: DataFrame | None = None
    unify_nulls: bool = True
    today: date = field(default_factory=date.today)

    def columns(self, *dtypes: str) -> list[str]:
        return [p["column"] for p in self.profiles if p["dtype"] in dtypes]


Check = Callable[[Context], tuple[DataFrame | None, DataFrame | None]]


def null_unify(ctx: Context):
    """Words for a missing value become empty, in cells that no other change wants."""
    if not ctx.unify_nulls:
        return None, None
    # the text of a null cell is "None", as a proposal would show it
    shown = cells(ctx.df).where(t.null_like(F.col("raw"))).withColumn("raw", F.coalesce("raw", F.lit("None")))
    found = shown.where(t.strip(F.col("raw")) != "")
    if ctx.occupied is not None:
        taken = ctx.occupied.where(F.col("column").isNotNull() & F.col("row_index").isNotNull()).select("column", "row_index").distinct()
        found = found.join(taken, ["column", "row_index"], "left_anti")
    return change(found, kind="coherence_fix", column=F.col("column"), row=F.col("row_index"), before=F.col("raw"), after=F.lit(""), rule=F.lit("null:unify"), confidence=F.lit(1.0)), None


def locale_ambiguous(ctx: Context):
    names = [(p["column"],) for p in ctx.profiles if p["dtype"] == "string" and "numeric_locale_ambiguous" in p["flags"]]
    return None, warning(ctx.df.sparkSession.createDataFrame(names, "column string"), "warn_ambiguous", col=F.col("column"))


def high_null(ctx: Context):
    rows = [(p["column"], p["null_like_rate"]) for p in ctx.profiles if p["null_like_rate"] > 0.5]
    return None, warning(ctx.df.sparkSession.createDataFrame(rows, "column string, rate double"), "warn_high_null", col=F.col("column"), rate=F.col("rate"))


def duplicate_columns(ctx: Context):
    """Pairs of columns that are equal in every row: fingerprints name the candidates, one pass compares them."""
    return None, warning(equal_columns(ctx.df), "warn_duplicate_columns", col1=F.col("col1"), col2=F.col("col2"))


def equal_columns(df: DataFrame) -> DataFrame:
    spark, names = df.sparkSession, columns_of(df)
    clean = {c: F.when(t.null_like(F.col(f"`{c}`").cast("string")), F.lit("")).otherwise(t.strip(F.col(f"`{c}`").cast("string"))) for c in names}
    prints = df.agg(*[F.bit_xor(F.xxhash64(F.col("row_index"), clean[c])).alias(f"_{i}") for i, c in enumerate(names)]).first() if names else ()
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if prints[i] == prints[j]]
    if pairs:
        same = df.agg(*[F.count_if(clean[names[i]] != clean[names[j]]).alias(f"_{i}_{j}") for i, j in pairs]).first()
        pairs = [p for p, n in zip(pairs, same, strict=True) if n == 0]
    return spark.createDataFrame([(names[i], names[j]) for i, j in pairs], "col1 string, col2 string")


def future_dates(ctx: Context):
    columns = ctx.columns("datetime")
    if not columns:
        return None, None
    return None, warning(future_counts(ctx.values.where(F.col("column").isin(*columns)), ctx.today), "warn_future_dates", col=F.col("column"), count=F.col("n"), today=F.lit(ctx.today.isoformat()))


def future_counts(values: DataFrame, today: date) -> DataFrame:
    """column, n: rows whose date lies after today. values: a dictionary of date columns."""
    found = dates.parsed(values.where(~F.col("missing")), dates.orders(values))
    late = found.where(F.substring("iso", 1, 10) > today.isoformat())
    return late.groupBy("column").agg(F.sum("n").alias("n"))


def email_shape(ctx: Context):
    columns = ctx.columns("string", "category")
    if not columns:
        return None, None
    return None, warning(bad_emails(ctx.values.where(F.col("column").isin(*columns))), "warn_email_shape", col=F.col("column"), count=F.col("n"))


def bad_emails(values: DataFrame) -> DataFrame:
    """column, n: values without an email's shape, in columns that are named or mostly filled as emails."""
    seen = values.where(~F.col("missing"))
    counted = seen.groupBy("column").agg(F.sum("n").alias("present"), F.sum(F.when(F.col("token").contains("@"), F.col("n")).otherwise(0)).alias("signs"), F.sum(F.when(F.col("token").rlike(t.EMAIL), 0).otherwise(F.col("n"))).alias("n"))
    of_emails = F.lower("column").contains("mail") | (F.col("signs") / F.col("present") > 0.5)
    return counted.where(of_emails & (F.col("n") > 0)).select("column", "n")


NON_NEGATIVE = re.compile(r"\b(?:" + "|".join(t.NON_NEGATIVE_NAMES) + r")\b", re.I)


def negative_values(ctx: Context):
    spark, found = ctx.df.sparkSession, None
    for p in ctx.profiles:
        if p["dtype"] in ("int64", "float64") and NON_NEGATIVE.search(p["column"]):
            n = negatives(ctx.values.where(F.col("column") == p["column"]), p["thousands"], p["decimal"])
            found = n if found is None else found.unionByName(n)
    return None, warning(found if found is not None else spark.createDataFrame([], "column string, n long"), "warn_negative_values", col=F.col("column"), count=F.col("n"))


def negatives(values: DataFrame, thousands: str | None, decimal: str | None) -> DataFrame:
    number = t.to_double(t.clean_number(F.col("token"), thousands, decimal, currency=False))
    return values.where(~F.col("missing") & (number < 0)).groupBy("column").agg(F.sum("n").alias("n"))


#: The checks that run, in order; append to it to add one.
CHECKS: list[Check] = [null_unify, locale_ambiguous, high_null, duplicate_columns, future_dates, email_shape, negative_values]


def run_checks(ctx: Context, checks: list[Check] | None = None) -> tuple[DataFrame, DataFrame]:
    spark = ctx.df.sparkSession
    ledger, notes = empty(spark), spark.createDataFrame([], WARNINGS)
    for check in CHECKS if checks is None else checks:
        changes, warnings = check(ctx)
        ledger = ledger if changes is None else ledger.unionByName(changes)
        notes = notes if warnings is None else notes.unionByName(warnings)
    return ledger, notes


def context(df: DataFrame, profiles: list, **options) -> Context:
    return Context(df, profiles, dictionary(df, None, None), **options)
