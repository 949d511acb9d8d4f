"""What is computed once and used twice lies in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local_folder(spark: SparkSession) -> str:
    """A new folder of this machine, which only a local master's tasks share."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="cellweave-")


def new_folder(spark: SparkSession) -> str:
    """A path in spark.checkpoint.dir that nothing else uses; with a local master and without that setting, one on this machine."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or _local_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir, so that a lost executor loses nothing; with a local master and without that setting on this machine."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_local_folder(spark))
    return df.checkpoint()
