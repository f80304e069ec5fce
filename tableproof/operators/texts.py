"""Text normalisation, and merging of a category column's near-equal values into the most frequent one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions.similarity import scored
from tableproof.functions.text import surface
from tableproof.operators.ledger import WARNINGS, change, empty, warning
from tableproof.plans.cells import cells_with, dictionary
from tableproof.plans.groups import components_in
from tableproof.plans.held import hold


def surfaces(df: DataFrame, columns: list[str], case: str = "keep") -> DataFrame:
    """column, raw, n, first_row, surface of the columns' distinct values that aren't missing: held."""
    values = dictionary(df, columns, None).where(~F.col("missing"))
    return hold(values.select("column", "raw", "n", "first_row", surface(F.col("raw"), case).alias("surface")))


def text_changes(df: DataFrame, columns: list[str], shown: DataFrame) -> DataFrame:
    """text_norm for the cells whose value has another surface. shown: surfaces() of the columns."""
    found = cells_with(df, columns, shown.where(F.col("surface") != F.col("raw")).select("column", "raw", "surface"))
    return change(found, kind="text_norm", column=F.col("column"), row=F.col("row_index"), before=F.col("raw"), after=F.col("surface"), rule=F.lit("text:surface"), confidence=F.lit(1.0))


def frequencies(shown: DataFrame) -> DataFrame:
    """column, surface, n, first_row, at (its place among the column's surfaces in code point order)."""
    counted = shown.groupBy("column", "surface").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    return counted.withColumn("at", F.row_number().over(Window.partitionBy("column").orderBy("surface")).cast("long"))


def links(values: DataFrame, threshold: float) -> DataFrame:
    """column, a, b, similarity: pairs of a column's values (by place) that are similar enough, in lower case."""
    low = values.select("column", "at", F.lower("surface").alias("low"))
    left, right = low.select("column", F.col("at").alias("a"), F.col("low").alias("left")), low.select("column", F.col("at").alias("b"), F.col("low").alias("right"))
    pairs = left.join(right, "column").where(F.col("a") < F.col("b"))
    return scored(pairs, "left", "right", least=threshold).select("column", "a", "b", "similarity")


def clusters(values: DataFrame, threshold: float) -> DataFrame:
    """values with cluster (the place of its first member) and winner (most frequent member, ties to the earliest row)."""
    linked = components_in(links(values, threshold), "column").select("column", F.col("node").alias("at"), F.col("root").alias("_root"))
    grouped = values.join(linked, ["column", "at"], "left").withColumn("cluster", F.coalesce("_root", "at")).drop("_root")
    winners = grouped.groupBy("column", "cluster").agg(F.max_by("surface", F.struct(F.col("n"), -F.col("first_row"))).alias("winner"), F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_list("surface")), ", ").alias("listed"))
    return grouped.join(winners, ["column", "cluster"])


def category_changes(df: DataFrame, columns: list[str], shown: DataFrame, clustered: DataFrame) -> DataFrame:
    """cat_merge where a cell's surface isn't its cluster's winner, text_norm where only its surface differs."""
    placed = hold(shown.join(clustered.select("column", "surface", "winner"), ["column", "surface"]))
    losers = clustered.where(F.col("winner") != F.col("surface")).select("column", "surface", "winner", F.lower("surface").alias("l"), F.lower("winner").alias("r"))
    sure = scored(losers, "l", "r").select("column", "surface", "similarity")
    moved = placed.where((F.col("winner") != F.col("surface")) & (F.col("winner") != F.col("raw"))).join(sure, ["column", "surface"])
    merged = cells_with(df, columns, moved.select("column", "raw", "winner", "similarity"))
    merges = change(merged, kind="cat_merge", column=F.col("column"), row=F.col("row_index"), before=F.col("raw"), after=F.col("winner"), rule=F.lit("text:cat_merge"), confidence=F.col("similarity") / 100)
    # a cell that is its winner already is proposed its surface, if that differs, as in any text column
    return merges.unionByName(text_changes(df, columns, placed.where((F.col("winner") == F.col("surface")) | (F.col("winner") == F.col("raw")))))


def normalize_text(df: DataFrame, strings: list[str], categories: list[str], *, case: str = "keep", cat_threshold: float = 90) -> tuple[DataFrame, DataFrame]:
    """Ledger and warnings of the string and category columns."""
    spark = df.sparkSession
    ledger, notes = empty(spark), spark.createDataFrame([], WARNINGS)
    if strings:
        ledger = ledger.unionByName(text_changes(df, strings, surfaces(df, strings, case)))
    if categories:
        shown = surfaces(df, categories, case)
        clustered = hold(clusters(frequencies(shown), cat_threshold))
        ledger = ledger.unionByName(category_changes(df, categories, shown, clustered))
        several = clustered.where(F.col("members") > 1).select("column", "cluster", "listed", "winner").distinct()
        notes = notes.unionByName(warning(several, "warn_cat_merged", col=F.col("column"), members=F.col("listed"), winner=F.col("winner")))
    return ledger, notes
