"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage: a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_local_folder: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="stateloom-"))
    return "file://" + _local_folder[0]


class Scratch:
    """Tables of one operator call, each under a name of its own.

    An operator makes one unless it is given one.  Its result reads these tables, so they
    stay until the caller, who passed the scratch in and has used the result, closes it:
    ``with Scratch(spark, "names") as s: near_duplicates(docs, scratch=s).write...``.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self._made = 0

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        """df written once and read back, and its path."""
        path = f"{self.root}/{self._made:03d}"
        self._made += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame) -> DataFrame:
        return self.table(df)[0]

    def close(self) -> None:
        """Delete all tables of this scratch."""
        self.drop(self.root)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def drop(self, path: str | None) -> None:
        """Delete a table that nothing reads any more."""
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _is_stored(df: DataFrame) -> bool:
    """Whether df is a table of files, at most with columns or rows left out."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.metadataOutput().nonEmpty()


#: Files of which the places where they begin may be broadcast: some 2 MB of paths and numbers.
BROADCAST_FILES = 10_000


def with_rank(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df and every row's rank in the table's order (long, from 0): part by part, row by row.

    A table written from range-sorted rows holds their order in this way.  What is not yet a
    table of files is written first.  The places where files begin (one row per file) are
    broadcast if the files are no more than BROADCAST_FILES, and joined by shuffle beyond.
    """
    if not _is_stored(df):
        df = (scratch or Scratch(df.sparkSession, "order")).keep(df)
    # The columns of df travel in a struct, so none can clash.
    placed = df.select(F.struct(*df.columns).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    part = F.expr(r"try_cast(regexp_extract(file, 'part-([0-9]+)[^/]*$', 1) AS long)")
    earlier = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("file").agg((F.max("at") + 1).alias("rows"))
    begins = sizes.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("begin"))
    begins = F.broadcast(begins) if len(df.inputFiles()) <= BROADCAST_FILES else begins
    return placed.join(begins, "file").select("row.*", (F.col("begin") + F.col("at")).alias(name))
