"""Dense row numbers without ordering a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableproof.plans.cells import ROW
from tableproof.plans.held import hold

OFFSET = (1 << 33) - 1


def number_rows(df: DataFrame) -> DataFrame:
    """df with row_index from 0 in the order of its partitions: sizes are counted first, then offsets added.

    df must give the same rows in the same partitions twice, as scans of files and held tables do.
    """
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(OFFSET)
    marked = df.withColumn("_at", F.monotonically_increasing_id())
    sizes = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a partition
    start, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((r["part"], start))
        start += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    joined = marked.withColumn("_part", part).join(F.broadcast(table), "_part")
    return joined.select((F.col("_start") + within).alias(ROW), *[F.col(f"`{c}`") for c in df.columns])


def renumber(df: DataFrame, step: int = 65_536) -> DataFrame:
    """df with its row_index made dense again: rows are counted by stretch, and ranked inside their stretch."""
    from pyspark.sql import Window

    stretch = F.floor(F.col(ROW) / step)
    counts = df.groupBy(stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    # one row a stretch of step rows: their running sum is the only thing ordered as a whole
    starts = counts.select("_stretch", F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = df.withColumn("_stretch", stretch).join(starts, "_stretch")
    rank = F.row_number().over(Window.partitionBy("_stretch").orderBy(ROW)) - 1 + F.col("_start")
    return joined.withColumn("_rank", rank).select(F.col("_rank").cast("long").alias(ROW), *[F.col(f"`{c}`") for c in df.columns if c != ROW])


def number_by(df: DataFrame, *order: str) -> DataFrame:
    """df with row_index from 0 in the order of columns that tell rows apart (a key): range-partitioned, then numbered."""
    ranged = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*order)
    return number_rows(hold(ranged))


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(ROW).limit(n)


