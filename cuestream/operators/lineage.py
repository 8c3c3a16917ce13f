"""Cutting the lineage of iterated plans in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that is set already. Only a local master may do with a temporary folder:
    on a cluster it would not be seen by others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    folder = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder by whatever comes later."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
