"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.plans.held import hold, shared_folder

__all__ = ["WORD", "WS", "batches_of", "benchmark", "broadcast_if", "documents", "free_name", "give_back", "hold", "hold_fit", "join_hot", "let", "pages", "shared_folder", "ship", "word_count", "words"]

#: Words are runs of anything but the ASCII white space of this class.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Functions of this module travel to the workers by value: executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def give_back() -> None:
    """Memory that arrow and the C library keep after large batches goes back to the system: workers and driver live on."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row.

    A plain reference inside a lambda may be inlined by the optimizer and then computed again for every element;
    binding it as the element of a one-element array cannot.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hold_fit(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """hold(df) in tasks of about so many rows: small tables of many partitions make many small files otherwise."""
    held = hold(df)
    tasks = held._jdf.queryExecution().toRdd().count() // rows + 1  # a plain job: the driver keeps no plan of it
    return held.coalesce(tasks) if tasks < held._jdf.rdd().getNumPartitions() else held


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside goes to Python in batches of at most so many rows, as suits rows of whole texts."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (they are counted); call it on held, narrow tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: list[str], rows: int, *, how: str = "inner", salts: int = 64) -> DataFrame:
    """left joined with right (held, one row a key), where one key may hold much of left.

    right is broadcast if it has at most so many rows (they are counted); else it is repeated over salts, and left's rows
    of a key are dealt out over them by a hash of the columns spread. Keys are not null (a struct of a null is none).
    """
    if right.limit(rows + 1).count() <= rows:
        return left.join(F.broadcast(right), key, how)
    salt = free_name("salt", [*left.columns, *right.columns])
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).join(salted, [key, salt], how).drop(salt)


def free_name(name: str, columns: list[str]) -> str:
    """name, or name with as many underscores as make it none of columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
