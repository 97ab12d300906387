"""A current table in immutable versions: batches rewrite only the partitions that they touch.

A version is a small manifest: the folder of each hash partition of the key, and the last
batch of each application.  Folders are written once and never changed.  Publishing version
n + 1 is the exclusive creation of its manifest, so of two writers that both started from
version n one wins; the other starts again from the new version, where it decides its
updates anew (``expected`` is compared with what is current then).  A batch that is run
again finds its number in the manifest and changes nothing.

A manifest is written whole under another name and then linked (POSIX folders) or renamed
without overwriting (other Hadoop file systems), which is atomic on HDFS; a store without
such a rename needs one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS, PARTS = "_versions", "parts"


class Conflict(Exception):
    """Another writer published first, more often than a writer tries."""


class Snapshot(NamedTuple):
    """One version: partition -> folder below the table, application -> last batch."""

    version: int
    folders: dict[int, str]
    applications: dict[str, int]


class VersionedTable:
    """Rows by ``key`` with a ``generation``; one row per key is current."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, generation: str, partitions: int = 16):
        self.spark, self.root, self.key, self.generation, self.partitions = spark, root.rstrip("/"), key, generation, partitions
        self.schema = spark.createDataFrame([], schema).schema

    # Files, by Hadoop's file systems

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path(VERSIONS).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder, fs = self._path(VERSIONS), self._fs()
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest without a number; version 0 is empty."""
        numbers = self._numbers()
        version = (numbers[-1] if numbers else 0) if version is None else version
        if not version:
            return Snapshot(0, {}, {})
        stream = self._fs().open(self._path(VERSIONS, f"{version:012d}.json"))
        try:
            made = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(version, {int(p): f for p, f in made["folders"].items()}, made["applications"])

    def _publish(self, made: Snapshot) -> bool:
        """False if this version exists already."""
        fs = self._fs()
        # Written whole under another name first, so no reader sees half a manifest and no claim outlives its writer.
        draft, final = self._path(VERSIONS, f".{uuid.uuid4().hex}"), self._path(VERSIONS, f"{made.version:012d}.json")
        out = fs.create(draft, False)
        out.write(json.dumps({"folders": made.folders, "applications": made.applications}).encode())
        out.close()
        try:
            (self._link if fs.getScheme() == "file" else self._rename)(draft, final)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            return False
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)

    def _link(self, draft, final) -> None:
        jvm = self.spark._jvm
        at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)]
        jvm.java.nio.file.Files.createLink(*at)

    def _rename(self, draft, final) -> None:
        """A rename that fails where the name is taken."""
        jvm = self.spark._jvm
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(kinds, 1)
        none[0] = kinds.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)

    # Rows

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.partitions)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders.values()])

    def read(self, version: int | None = None) -> DataFrame:
        """The current rows of a version, the newest without a number."""
        return self._rows(self.snapshot(version).folders)

    def lookup(self, keys: list) -> DataFrame:
        """The current rows of some keys, from their partitions alone."""
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        parts = {r[0] for r in asked.select(self._part(F.col(self.key))).distinct().collect()}
        now = self.snapshot()
        return self._rows({p: f for p, f in now.folders.items() if p in parts}).join(asked, self.key, "left_semi")

    def merge(
        self, updates: DataFrame, application: str | None = None, batch: int | None = None, *, expected: str = "expected", tries: int = 5, meanwhile: Callable[[], None] | None = None
    ) -> int | None:
        """Publishes the updates whose ``expected`` generation is the current one (0: no row); the new version.

        ``updates``: the table's columns and ``expected``; a row whose generation is null deletes
        its key.  Of several updates to a key that fit, the least by its columns in order wins.
        Others are refused: they change nothing, as does a batch that was merged before (None).
        Only touched partitions are read and rewritten.  ``meanwhile`` runs before each attempt
        to publish.
        """
        columns = [f.name for f in self.schema]
        keyed = updates.select(*columns, F.col(expected).alias("_expected"), self._part(F.col(self.key)).alias("_part"))
        touched = sorted(r[0] for r in keyed.select("_part").distinct().collect())  # at most ``partitions``
        for _ in range(tries):
            now = self.snapshot()
            if application is not None and now.applications.get(application, -1) >= batch:
                return None
            old = self._rows({p: f for p, f in now.folders.items() if p in touched})
            have = old.select(self.key, F.col(self.generation).alias("_have"))
            fits = keyed.join(have, self.key, "left").where(F.col("_expected") == F.coalesce("_have", F.lit(0)))
            won = fits.groupBy(self.key).agg(F.min(F.struct(*[c for c in columns if c != self.key])).alias("w")).select(self.key, "w.*").select(*columns)
            kept = old.join(won.select(self.key), self.key, "left_anti")
            rows = kept.unionByName(won.where(F.col(self.generation).isNotNull())).withColumn("_part", self._part(F.col(self.key)))
            # Writing by partition: each rewritten one is a folder of its own, with a name that no other attempt has.
            folder = f"{PARTS}/{now.version + 1:012d}-{uuid.uuid4().hex}"
            rows.repartition(len(touched) or 1, "_part").write.partitionBy("_part").parquet(f"{self.root}/{folder}")
            fs = self._fs()
            full = {p for p in touched if fs.exists(self._path(folder, f"_part={p}"))}
            folders = {p: f for p, f in now.folders.items() if p not in touched} | {p: f"{folder}/_part={p}" for p in full}
            applications = now.applications | ({application: batch} if application is not None else {})
            if meanwhile:
                meanwhile()
            if self._publish(Snapshot(now.version + 1, folders, applications)):
                return now.version + 1
            fs.delete(self._path(folder), True)
        raise Conflict(f"no version published in {tries} tries")

    def sink(self, application: str, expected: str = "expected") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: every batch is merged once."""
        return lambda rows, batch: self.merge(rows, application, batch, expected=expected) and None

    def vacuum(self, keep: int = 10) -> int:
        """Deletes versions but the last ``keep`` and the folders that only they name; the number of versions deleted.

        A folder that no version names is left: it may be that of a writer who is about to publish.
        """
        numbers, fs = self._numbers(), self._fs()
        gone, left = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
        needed = {f for n in left for f in self.snapshot(n).folders.values()}
        for n in gone:
            for f in set(self.snapshot(n).folders.values()) - needed:
                fs.delete(self._path(f), True)
            fs.delete(self._path(VERSIONS, f"{n:012d}.json"), False)
        return len(gone)
