"""The shared folder that cuts lineage, and places in it for tables and logs of a query's own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the cluster's checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; one of our own only where none is set, and only in local sessions."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder as a path that open() takes; None where only Spark reads it."""
    ensure_checkpoint_dir(spark)
    found = re.fullmatch(r"(?:file:(?://)?)?(/.*)", spark.sparkContext.getCheckpointDir())
    return found and found[1]


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for a log or table that goes with it."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("logs are written through the file system; spark.checkpoint.dir must be a mounted folder")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
