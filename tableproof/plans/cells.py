"""The long form of a table and its value dictionary, on which everything that looks at a column as a whole is built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableproof.functions.tokens import null_like, strip
from tableproof.plans.held import hold

ROW = "row_index"


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row_index, column, raw: a row for each cell of a table of text columns."""
    names = columns_of(df) if columns is None else columns
    if not names:
        return df.select(ROW, F.lit("").alias("column"), F.lit("").alias("raw")).where(F.lit(False))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in names])
    return df.select(ROW, F.explode(pairs).alias("_")).select(ROW, "_.column", "_.raw")


def first_rows(rows: DataFrame, keys: list[str], k: int, step: int = 8192) -> DataFrame:
    """keys, last: the row_index of each group's k-th row, for groups of over k rows.

    Rows are counted in stretches of step row numbers; only the stretch that holds the k-th row is ordered.
    """
    stretch = F.floor(F.col(ROW) / step)
    counts = rows.groupBy(*keys, stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("_total", total).withColumn("_before", before).where((F.col("_total") > k) & (F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k))
    inside = rows.withColumn("_stretch", stretch).join(edge.select(*keys, "_stretch", "_before"), [*keys, "_stretch"])
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(ROW)) + F.col("_before"))
    return ranked.where(F.col("_rank") == k).select(*keys, F.col(ROW).alias("last"))


def first_present(df: DataFrame, names: list[str], k: int, step: int = 8192) -> list[tuple[str, int]]:
    """column and row_index of its k-th row that isn't missing, for columns of over k such rows: at most a row a column.

    One pass counts by stretch of step rows, for all columns side by side; only the stretches with a k-th row are ordered.
    """
    if not names:
        return []
    stretch = F.floor(F.col(ROW) / step)
    present = [F.count_if(~null_like(F.col(f"`{c}`").cast("string"))).alias(f"_{i}") for i, c in enumerate(names)]
    wide = df.groupBy(stretch.alias("_stretch")).agg(*present)
    counts = wide.select("_stretch", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n")) for i, c in enumerate(names)])).alias("_")).select("_stretch", "_.*")
    total = F.sum("n").over(Window.partitionBy("column"))
    upto = F.sum("n").over(Window.partitionBy("column").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumn("_total", total).withColumn("_upto", upto).where((F.col("_total") > k) & (F.col("_upto") >= k) & (F.col("_upto") - F.col("n") < k))
    edges = [(r["column"], r["_stretch"], r["_upto"] - r["n"]) for r in edge.collect()]  # a row a column
    if not edges:
        return []
    places = df.sparkSession.createDataFrame(edges, "column string, _stretch long, _before long")
    some = cells(df.where(stretch.isin(*{e[1] for e in edges})), sorted(e[0] for e in edges)).where(~null_like(F.col("raw")))
    inside = some.withColumn("_stretch", stretch).join(F.broadcast(places), ["column", "_stretch"])
    ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy("column").orderBy(ROW)) + F.col("_before"))
    return [(r["column"], r[ROW]) for r in ranked.where(F.col("_rank") == k).select("column", ROW).collect()]  # a row a column


def dictionary(df: DataFrame, columns: list[str] | None = None, max_sample: int | None = 50_000) -> DataFrame:
    """column, raw, token, missing, n, sampled, first_row: a row for each distinct value of each column. It is held.

    sampled counts the value's rows among the column's first max_sample rows that aren't missing.
    """
    names = columns_of(df) if columns is None else columns
    long = cells(df, names)
    inside = F.count(F.lit(1))
    last = first_present(df, names, max_sample) if max_sample is not None else []
    if last:
        long = long.join(F.broadcast(df.sparkSession.createDataFrame(last, "column string, last long")), "column", "left")
        inside = F.count_if(F.col("last").isNull() | (F.col(ROW) <= F.col("last")))
    values = long.groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"), inside.alias("inside"), F.min(ROW).alias("first_row"))
    marked = values.withColumn("missing", null_like(F.col("raw")))
    return hold(marked.select("column", "raw", F.when(~F.col("missing"), strip(F.col("raw"))).alias("token"), "missing", "n", F.when(F.col("missing"), F.lit(0)).otherwise(F.col("inside")).cast("long").alias("sampled"), "first_row"))


def cells_with(df: DataFrame, columns: list[str], values: DataFrame, rows: int = 200_000) -> DataFrame:
    """The cells of columns whose value is in values (column, raw, more), with what is more.

    values, usually the few that some rule changes, are held and broadcast up to so many rows (they are counted); more
    are joined by shuffle, where the adaptive join splits values that very many cells have.
    """
    held = hold(values)
    small = held.limit(rows + 1).count() <= rows
    return cells(df, columns).join(F.broadcast(held) if small else held, ["column", "raw"])
