"""From raw documents to a training mix: language, boilerplate lines, near copies, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last adds taken
(words the mix takes of the document, repeats counted) and copies (whole ones). run() writes each stage's rows as
Parquet to the shared folder and reads them again, so a lost executor costs one stage's tasks at most. Of the stages'
folders only the last one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableproof.llm import crf_langid, decontaminate, line_spread, mixing, near_dedup
from tableproof.llm.common import benchmark, documents, free_name, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are mostly of one learned language, or of a few; "und" ones go."""
    return crf_langid.readable(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sites share, but for each line's first document."""
    removed = free_name("n_removed", docs.columns)
    cleaned = line_spread.remove_boilerplate(docs, count_column=removed)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return cleaned.drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in its own or in other numbers and names."""
    return decontaminate.clean(docs, benchmark(spark, sf_dir))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with taken and copies."""
    return mixing.mixed_documents(docs, added=(free_name("taken", docs.columns), free_name("copies", docs.columns)))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The first stage is a learned model, so SQL can't give run()'s rows; tests/llm compares the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # what the stage before wrote has been read for the last time
            _remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
