"""Date normalisation: the order of day and month is voted by column, then cells are proposed in ISO form.

Each distinct value is parsed, not each cell: what changes is joined back to its cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.functions import dates as d
from tableproof.operators.ledger import change, empty, warning
from tableproof.plans.cells import cells_with, dictionary
from tableproof.plans.held import hold


def orders(values: DataFrame, allow_epoch_excel: bool = False) -> DataFrame:
    """column, order: DMY if any first field is over 12, else MDY if any second one is, else null. values: a dictionary."""
    open_ = ~F.col("missing") & d.unambiguous(F.col("token"), allow_epoch_excel).isNull() & d.is_numeric(F.col("token"))
    days_first = F.bool_or(open_ & (d.first_field(F.col("token")) > 12))
    days_second = F.bool_or(open_ & (d.second_field(F.col("token")) > 12))
    return values.groupBy("column").agg(F.when(days_first, "DMY").when(days_second, "MDY").alias("order"))


def parsed(rows: DataFrame, order: DataFrame, allow_epoch_excel: bool = False) -> DataFrame:
    """rows (column, token) with iso and state: resolved, ambiguous or failed. order has a row a column."""
    sure = d.unambiguous(F.col("token"), allow_epoch_excel)
    joined = rows.join(F.broadcast(order), "column", "left").withColumn("_sure", sure)
    iso = F.coalesce(F.col("_sure"), d.ordered(F.col("token"), F.col("order")))
    state = F.when(iso.isNotNull(), "resolved").when(F.col("order").isNull() & d.is_numeric(F.col("token")), "ambiguous").otherwise("failed")
    return joined.withColumn("iso", iso).withColumn("state", state).drop("_sure", "order")


def date_changes(df: DataFrame, columns: list[str], order: DataFrame, allow_epoch_excel: bool = False, *, states: DataFrame | None = None) -> DataFrame:
    """The ledger of the columns' dates. states: parsed() of the columns' dictionary, where it is at hand."""
    if states is None:
        states = parsed(dictionary(df, columns, None).where(~F.col("missing")), order, allow_epoch_excel)
    found = cells_with(df, columns, states.where(F.col("iso") != F.col("token")).select("column", "raw", "token", "iso"))
    return change(found, kind="date_norm", column=F.col("column"), row=F.col("row_index"), before=F.col("token"), after=F.col("iso"), rule=F.lit("date:iso"), confidence=F.lit(1.0))


def tallies(values: DataFrame, order: DataFrame, allow_epoch_excel: bool = False) -> DataFrame:
    """column, present, resolved, ambiguous, failed: rows by state."""
    return by_state(parsed(values.where(~F.col("missing")), order, allow_epoch_excel))


def by_state(states: DataFrame) -> DataFrame:
    count = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(s)
    return states.groupBy("column").agg(F.sum("n").alias("present"), count("resolved"), count("ambiguous"), count("failed"))


def date_warnings(counted: DataFrame) -> DataFrame:
    unparsed = warning(counted.where(F.col("failed") > 0), "warn_date_unparsed", col=F.col("column"), count=F.col("failed"))
    open_ = warning(counted.where(F.col("ambiguous") > 0), "warn_date_ambiguous", col=F.col("column"), count=F.col("ambiguous"))
    none = warning(counted.where((F.col("resolved") == 0) & (F.col("ambiguous") == 0) & (F.col("present") > 0)), "warn_date_none", col=F.col("column"))
    return unparsed.unionByName(open_).unionByName(none)


def gate(counted: DataFrame, fail_rate: float = 0.05, ambig_blocks: bool = True) -> DataFrame:
    """column, blocked: whether the column's dates stop the export."""
    failing = (F.col("resolved") > 0) & (F.col("failed") / F.col("present") > fail_rate)
    return counted.select("column", (failing | ((F.col("ambiguous") > 0) & F.lit(ambig_blocks))).alias("blocked"))


def normalize_dates(df: DataFrame, columns: list[str], *, allow_epoch_excel: bool = False, fail_rate: float = 0.05, ambig_blocks: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, warnings and gate (column, blocked) of the date columns."""
    spark = df.sparkSession
    if not columns:
        return empty(spark), spark.createDataFrame([], "key string, params map<string,string>"), spark.createDataFrame([], "column string, blocked boolean")
    values = dictionary(df, columns, None)
    order = orders(values, allow_epoch_excel)
    states = hold(parsed(values.where(~F.col("missing")), order, allow_epoch_excel))
    counted = by_state(states)
    return date_changes(df, columns, order, allow_epoch_excel, states=states), date_warnings(counted), gate(counted, fail_rate, ambig_blocks)
