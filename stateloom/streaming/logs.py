"""Logs followed as streams: lines as they arrive, their diagnostics, and when each source last spoke."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textlog import diagnose_lines


def follow(spark: SparkSession, folder: str, suffix: str = ".log", files_per_batch: int = 1000) -> DataFrame:
    """A stream of (source, line, arrived_at) from text files below a folder; source is the file's name.

    A writer appends by adding files (``name.<part>.log`` is source ``name``), as streams of
    files read each file once.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)
    return lines.select(name.alias("source"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived_at"))


def diagnosed(lines: DataFrame) -> DataFrame:
    """The stream's lines that match the pattern catalogue, with code, severity and stop; no state is kept."""
    return diagnose_lines(lines)


def last_spoken(lines: DataFrame) -> DataFrame:
    """(source, last_at, n_lines): one updating row per source, as ``decisions.silent_sources`` takes them."""
    return lines.groupBy("source").agg(F.max("arrived_at").alias("last_at"), F.count("*").alias("n_lines"))
