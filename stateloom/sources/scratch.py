"""Intermediate tables of iterative operators, in the folder the session names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_made: list[str] = []


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's path below the session's checkpoint folder; a local one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="stateloom-"))
        root = _local[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame) -> DataFrame:
    """df written once and read back: lineage ends there, and a lost executor rereads it."""
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Deletes the tables made so far, once their results have been used; returns their number."""
    n = len(_made)
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n
