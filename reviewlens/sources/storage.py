"""The shared folder for tables that cut a lineage or outlive a query."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = os.path.join(tempfile.gettempdir(), "reviewlens-local")
    os.makedirs(folder, exist_ok=True)
    return folder


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


#: Whether the shuffle files of an execution are removed when it ends, for DataFrames made while it is set.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written below the shared folder, so that costly steps run once and lost executors
    cost no recomputation. Once they are written, the shuffle files that led to them are removed."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        # A DataFrame of its own: the one that was given, which may run again, keeps its files.
        own = df.select("*")
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    return own.checkpoint()
