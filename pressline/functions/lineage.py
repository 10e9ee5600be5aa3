"""Materialising an intermediate result that several branches read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode (tests, a laptop) a
    temporary folder may stand for it: on a cluster every executor would write to a
    disk of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read back, so that a join
    below several aggregations runs once and a lost executor costs a re-read."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
