"""Collected jobs into databases: one transaction a job, written once however often it is retried.

Jobs are dealt to shards by hash of their id, a shard is one database, and one task writes a
shard, so writers never meet in a database except as attempts of one task.  A job's run,
entries and products go in together with its digest, or not at all: a retried or repeated
job with the same digest is found there and left, one with another digest is replaced.  A job
whose transaction fails is reported, and its neighbours go on; degraded jobs store nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .journal_sink import local_path
from .scratch import scratch_table

TABLES = """
CREATE TABLE IF NOT EXISTS jobs (job_id TEXT PRIMARY KEY, digest TEXT NOT NULL, run_id TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS runs (id TEXT PRIMARY KEY, body TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS entries (job_id TEXT NOT NULL, id TEXT NOT NULL, kind TEXT, body TEXT NOT NULL, PRIMARY KEY (job_id, id));
CREATE TABLE IF NOT EXISTS products (job_id TEXT NOT NULL, id TEXT NOT NULL, body TEXT NOT NULL, PRIMARY KEY (job_id, id));
"""
REPORT = "job_id string, shard int, stored string, skipped string, storage_error string"


class SqliteShards:
    """``folder/shard-<n>.sqlite`` below a folder that all executors mount."""

    def __init__(self, folder: str, wait_seconds: float = 60.0):
        self.folder, self.wait = local_path(folder), wait_seconds

    def __call__(self, shard: int) -> sqlite3.Connection:
        os.makedirs(self.folder, exist_ok=True)
        made = sqlite3.connect(f"{self.folder}/shard-{shard:04d}.sqlite", timeout=self.wait, isolation_level=None)
        made.executescript(TABLES)
        return made


def _digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def store_job(db: Any, job: dict) -> str:
    """Stores one job in a transaction; the JSON report of what the database then holds of it.

    ``job``: job_id, run (id, body), entries and products (lists of id, kind, body).
    """
    job_id, run, entries, products = job["job_id"], job["run"], job["entries"], job["products"]
    digest = _digest(run, entries, products)
    report = json.dumps({"entries": [e["id"] for e in entries], "run": run["id"]}, sort_keys=True)
    # The write lock comes first, so another attempt's commit is seen or waited for.
    db.execute("BEGIN IMMEDIATE")
    try:
        have = db.execute("SELECT digest, run_id FROM jobs WHERE job_id = ?", (job_id,)).fetchone()
        if have is None or have[0] != digest:
            if have is not None:
                for table in ("entries", "products", "jobs"):
                    db.execute(f"DELETE FROM {table} WHERE job_id = ?", (job_id,))
                db.execute("DELETE FROM runs WHERE id = ?", (have[1],))
            db.execute("INSERT INTO runs VALUES (?, ?)", (run["id"], run["body"]))
            db.executemany("INSERT INTO entries VALUES (?, ?, ?, ?)", [(job_id, e["id"], e["kind"], e["body"]) for e in entries])
            db.executemany("INSERT INTO products VALUES (?, ?, ?)", [(job_id, p["id"], p["body"]) for p in products])
            db.execute("INSERT INTO jobs VALUES (?, ?, ?)", (job_id, digest, run["id"]))
        db.execute("COMMIT")
    except BaseException:
        db.execute("ROLLBACK")
        raise
    return report


def store_rows(rows: Iterator[dict], connect: Callable[[int], Any]) -> Iterator[tuple]:
    """The reports of jobs that come shard by shard."""
    shard, db = None, None
    try:
        for row in rows:
            if row["degraded"] is not None:
                yield row["job_id"], row["shard"], None, "degraded", None
                continue
            try:
                if row["shard"] != shard:
                    if db is not None:
                        db.close()
                    shard, db = row["shard"], None
                if db is None:
                    db = connect(shard)
                yield row["job_id"], shard, store_job(db, row), None, None
            except Exception as e:  # noqa: BLE001  a job that can't be stored is reported, the others go on
                yield row["job_id"], row["shard"], None, None, f"could not store job {row['job_id']}: {e}"
    finally:
        if db is not None:
            db.close()


def store_collected(collected: DataFrame, connect: Callable[[int], Any], shards: int = 1) -> DataFrame:
    """Stores collected jobs and returns their reports: job_id, shard, stored, skipped, storage_error.

    ``collected``: job_id (string), run struct<id, body>, entries and products
    array<struct<id, kind, body>>, degraded (why a job has no outputs, or null).  Jobs are
    stored before this returns; the reports are a table.
    """
    item = "array<struct<id: string, kind: string, body: string>>"
    none = lambda c: F.coalesce(F.col(c).cast(item), F.array().cast(item)).alias(c)
    shard = F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int").alias("shard")
    rows = collected.select("job_id", shard, F.to_json("run").alias("run"), F.to_json(none("entries")).alias("entries"), F.to_json(none("products")).alias("products"), "degraded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = (
                {"job_id": j, "shard": int(s), "run": json.loads(r) if r else None, "degraded": d}
                | {k: [{"kind": None, "body": None} | x for x in json.loads(v)] for k, v in (("entries", e), ("products", p))}
                for j, s, r, e, p, d in batch.itertuples(index=False)
            )
            yield pd.DataFrame(list(store_rows(parsed, connect)), columns=[c.split()[0] for c in REPORT.split(", ")])

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "job_id")
    return scratch_table(dealt.mapInPandas(run, REPORT))
