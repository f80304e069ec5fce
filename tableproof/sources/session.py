"""An analysis kept in a folder: profiles, ledger and warnings once, decisions appended."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tableproof.operators.ledger import DECISIONS, STATUSES, decide
from tableproof.plans.analysis import Analysis

TABLES = ("df", "profiles", "ledger", "warnings", "gates")


def _path(spark: SparkSession, folder: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(analysis: Analysis, folder: str) -> None:
    for name in TABLES:
        getattr(analysis, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> Analysis | None:
    """The analysis with all decisions made since; None where there is none."""
    where, system = _path(spark, f"{folder}/ledger")
    if not system.exists(where):
        return None
    kept = Analysis(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES))
    where, system = _path(spark, f"{folder}/decisions")
    if system.exists(where):
        kept.ledger = decide(kept.ledger, spark.read.schema(DECISIONS).parquet(f"{folder}/decisions"))
    return kept


def decide_on(changes: DataFrame, status: str, folder: str) -> None:
    """Appends one decision on each of the changes; the latest decision on a change counts."""
    from pyspark.sql import functions as F

    if status not in STATUSES:
        raise ValueError(f"status is one of {STATUSES}, not {status!r}")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    changes.select("id", F.lit(status).alias("status"), F.lit(now).cast("timestamp").alias("at")).write.mode("append").parquet(f"{folder}/decisions")


def clear(spark: SparkSession, folder: str) -> None:
    where, system = _path(spark, folder)
    system.delete(where, True)
