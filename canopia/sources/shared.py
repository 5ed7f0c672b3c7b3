"""The folder that driver and executors share, and lineage cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local master without it takes a temporary folder, any other refuses."""
    sc = spark.sparkContext
    set_there = sc.getConf().get("spark.checkpoint.dir")
    if not set_there and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (set_there or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, without their lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
