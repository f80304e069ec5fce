"""Tables that are read several times: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share.

    It is the one that spark.checkpoint.dir names; only a session that names none (a test) gets its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tableproof-"))
    return context.getCheckpointDir()


def hold(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: lineage ends, lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
