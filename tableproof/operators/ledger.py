"""The change ledger: its rows, identities, conflicts, decisions and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("id", "kind", "column", "row_index", "before", "after", "rule", "confidence", "status")
SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "row_index" else T.DoubleType() if n == "confidence" else T.StringType()) for n in FIELDS])
WARNINGS = "key string, params map<string,string>"
DECISIONS = "id string, status string, at timestamp"
#: Which kind of change stands when several want one cell.
PRIORITY = {"dedup": 0, "date_norm": 1, "cat_merge": 2, "text_norm": 3, "coherence_fix": 4, "type_cast": 5}
STATUSES = ("accepted", "pending", "rejected")


def change(df: DataFrame, *, kind: str | Column, column: Column | None, row: Column | None, before: Column, after: Column | None, rule: Column, confidence: Column) -> DataFrame:
    """Pending changes from the rows of df. A change's id is a hash of what it says, so reruns give the same ids."""
    none = F.lit(None)
    fields = df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (none if column is None else column).cast("string").alias("column"),
        (none if row is None else row).cast("long").alias("row_index"),
        before.cast("string").alias("before"),
        (none if after is None else after).cast("string").alias("after"),
        rule.cast("string").alias("rule"),
        confidence.cast("double").alias("confidence"),
    )
    said = F.to_json(F.struct("kind", "column", "row_index", "rule", "before", "after"))
    return fields.select(F.sha2(said, 256).alias("id"), "*", F.lit("pending").alias("status"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def warning(df: DataFrame, key: str, **params: Column) -> DataFrame:
    pairs = [x for name, value in params.items() for x in (F.lit(name), value.cast("string"))]
    return df.select(F.lit(key).alias("key"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("params"))


def by_kind(ledger: DataFrame, *kinds: str) -> DataFrame:
    return ledger.where(F.col("kind").isin(*kinds))


def accepted(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "accepted")


def priority(kind: Column) -> Column:
    rank: Column = F.lit(99)
    for name, value in PRIORITY.items():
        rank = F.when(kind == name, value).otherwise(rank)
    return rank


def resolve(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with one change a cell, and a warning for each change that had to go."""
    of_cells = ledger.where(F.col("column").isNotNull() & F.col("row_index").isNotNull())
    others = ledger.where(F.col("column").isNull() | F.col("row_index").isNull())
    cell = Window.partitionBy("column", "row_index").orderBy(priority(F.col("kind")), "id")
    ranked = of_cells.withColumn("_rank", F.row_number().over(cell)).withColumn("_kept", F.first("rule").over(cell))
    dropped = ranked.where(F.col("_rank") > 1)
    notes = warning(dropped, "warn_conflict", col=F.col("column"), row=F.col("row_index"), kept=F.col("_kept"), dropped=F.col("rule"))
    return others.unionByName(ranked.where(F.col("_rank") == 1).drop("_rank", "_kept")), notes


def decide(ledger: DataFrame, decisions: DataFrame) -> DataFrame:
    """The ledger with the latest decision on each change; changes that no decision names stay as they are."""
    latest = decisions.groupBy("id").agg(F.max_by("status", F.struct("at", "status")).alias("_decided"))
    return ledger.join(latest, "id", "left").withColumn("status", F.coalesce("_decided", "status")).select(*FIELDS)


def set_status(ledger: DataFrame, condition: Column, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status is one of {STATUSES}, not {status!r}")
    return ledger.withColumn("status", F.when(condition, F.lit(status)).otherwise(F.col("status")))


def counts_by_status(ledger: DataFrame) -> DataFrame:
    """A row for each of the three states, zero where none."""
    states = ledger.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counted = ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return states.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_by_kind(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def report_order() -> list[Column]:
    """Sort keys of a report: row (columns' changes first), column, kind, rule, before, after; nulls as empty."""
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("column", "kind", "rule", "before", "after")]
    return [F.coalesce(F.col("row_index"), F.lit(-1)), *text]


def canonical_order() -> list[Column]:
    """Sort keys of a resolved ledger: changes of no cell first, then by row, column and kind."""
    of_cell = F.col("column").isNotNull() & F.col("row_index").isNotNull()
    return [of_cell, F.coalesce(F.col("row_index"), F.lit(-1)), F.coalesce(F.col("column"), F.lit("")), F.col("kind"), F.col("id")]


def page(ledger: DataFrame, size: int = 200) -> tuple[DataFrame, int]:
    """The first changes in canonical order, as a screen shows them, and how many there are in all."""
    return ledger.orderBy(*canonical_order()).limit(size), ledger.count()


def confidence_badge(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.6, "mid").otherwise("low")
