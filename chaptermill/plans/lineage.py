"""Cutting lineage safely: reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where a local session has none, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="chaptermill-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: computed once, whole even if executors are lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
