"""Applying accepted changes: cells by one join, casts as expressions, superfluous rows by an anti join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableproof.functions import tokens as t
from tableproof.operators.ledger import accepted
from tableproof.plans.cells import ROW, columns_of
from tableproof.plans.rows import renumber


def cell_changes(ledger: DataFrame) -> DataFrame:
    return accepted(ledger).where(F.col("column").isNotNull() & F.col("row_index").isNotNull())


def mismatches(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """column, row_index, before, current: accepted changes whose cell doesn't hold what they were proposed for.

    Several changes of one cell are applied in order of their kind, so each but the first meets what the one before left.
    """
    from pyspark.sql import Window

    earlier = F.lag("after").over(Window.partitionBy("column", "row_index").orderBy("kind", "id"))
    nth = F.row_number().over(Window.partitionBy("column", "row_index").orderBy("kind", "id"))
    wanted = cell_changes(ledger).withColumn("_earlier", earlier).withColumn("_nth", nth)
    # the changes of a row meet it as one array: only rows with changes are opened, and only at the cells they name
    by_row = wanted.groupBy(ROW).agg(F.collect_list(F.struct("column", "before", "_earlier", "_nth")).alias("_wanted"))
    raw = F.create_map(*[x for c in columns_of(df) for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    opened = df.join(by_row, ROW).select(ROW, raw.alias("_cells"), F.explode("_wanted").alias("_"))
    known = opened.where(F.map_contains_key("_cells", F.col("_.column")))
    joined = known.select(ROW, F.col("_.column").alias("column"), F.col("_.before").alias("before"), F.when(F.col("_._nth") == 1, F.col("_cells")[F.col("_.column")]).otherwise(F.col("_._earlier")).alias("_met"))
    met = F.col("_met")
    text = lambda c: F.when(t.null_like(c), F.lit("")).otherwise(c)
    return joined.select("column", ROW, text(F.col("before")).alias("before"), text(met).alias("current")).where(F.col("before") != F.col("current"))


def apply_cells(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """df with accepted cell changes; of several for one cell, the one of the last kind stands. Nothing else moves."""
    last = cell_changes(ledger).groupBy(ROW, "column").agg(F.max_by("after", F.struct("kind", "id")).alias("after"))
    by_row = last.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", "after"))).alias("_cells"))
    joined = df.join(by_row, ROW, "left")
    return joined.select(ROW, *[F.when(F.map_contains_key("_cells", F.lit(c)), F.col("_cells")[c]).otherwise(F.col(f"`{c}`")).alias(c) for c in columns_of(df)])


def cast(c: Column, dtype: str, thousands: str | None, decimal: str | None) -> Column:
    """A text column as a type; what doesn't read as one is null. Category, string and datetime stay text."""
    if dtype in ("float64", "int64"):
        text = t.strip(t.clean_number(c, thousands, decimal))
        number = F.when(~t.null_like(c) & text.rlike(t.FLOAT), text)
        if dtype == "float64":
            return number.try_cast("double")
        whole = number.try_cast("decimal(38,18)")
        return F.when(whole == F.floor(whole), whole.try_cast("long"))
    if dtype == "bool":
        word = F.lower(t.strip(c))
        return F.when(t.null_like(c), F.lit(None)).when(word.isin(*t.TRUE_WORDS, "1"), F.lit(True)).when(word.isin(*t.FALSE_WORDS, "0"), F.lit(False))
    return c


def apply_casts(df: DataFrame, ledger: DataFrame, profiles: list) -> tuple[DataFrame, list[str]]:
    """df with the columns of accepted type_cast changes cast, and the casts made. profiles: rows of the profile table."""
    rows = accepted(ledger).where((F.col("kind") == "type_cast") & F.col("row_index").isNull()).select("column", "after").distinct().collect()  # a row a column
    locale = {p["column"]: (p["thousands"], p["decimal"]) for p in profiles}
    made = {r["column"]: r["after"] for r in rows if r["column"] in columns_of(df)}
    typed = df.select(ROW, *[(cast(F.col(f"`{c}`"), made[c], *locale.get(c, (None, None))) if c in made else F.col(f"`{c}`")).alias(c) for c in columns_of(df)])
    return typed, [f"{c}->{d}" for c, d in sorted(made.items())]


def dropped_rows(ledger: DataFrame) -> DataFrame:
    return accepted(ledger).where((F.col("kind") == "dedup") & F.col("column").isNull() & F.col("row_index").isNotNull()).select(ROW).distinct()


def apply_dedup(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """df without the rows of accepted dedup changes, numbered anew in the same order."""
    return renumber(df.join(dropped_rows(ledger), ROW, "left_anti"))


@dataclass
class Applied:
    df: DataFrame
    mismatches: DataFrame
    applied_by_kind: dict[str, int]
    rows_before: int
    rows_after: int
    casts: list[str]


def apply_changes(df: DataFrame, ledger: DataFrame, profiles: list) -> Applied:
    """Cells, then casts, then rows. Only accepted changes count; df itself is left as it is."""
    typed, casts = apply_casts(apply_cells(df, ledger), ledger, profiles)
    clean = apply_dedup(typed, ledger)
    by_kind = {r["kind"]: r["n"] for r in cell_changes(ledger).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
    if casts:
        by_kind["type_cast"] = len(casts)
    before, lost = df.count(), df.join(dropped_rows(ledger), ROW, "left_semi").count()
    named = dropped_rows(ledger).count()
    if named:
        by_kind["dedup"] = named
    return Applied(clean, mismatches(df, ledger), by_kind, before, before - lost, casts)
