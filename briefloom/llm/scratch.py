"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and Spark runs
in one process on one machine, a temporary folder is made and set; a cluster without one is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a path that Spark's readers and writers take."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="briefloom-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Bounds the bytes that one batch takes to a Python worker, by the session's own setting.
    Results never depend on it; memory does, where texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key).removesuffix("b")  # where it is unset, Spark's default
    if not own.isdigit() or not 0 < int(own) <= limit:
        spark.conf.set(key, str(limit))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table of the shared folder and reads it back: its lineage is
    cut, it survives lost executors, and its size is known to the planner."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else for a sort-merge join."""
    return df.hint("broadcast" if rows <= bound else "merge")
