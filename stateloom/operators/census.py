"""Counts and summaries over jobs, frames and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .predicates import aged, name_set


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by kind; kinds that do not occur have no row."""
    return jobs.groupBy("kind").agg(F.count("*").alias("n"))


def work_census(jobs: DataFrame, executors: Sequence[str], pools: Sequence[str] | None, offered: Sequence[str]) -> DataFrame:
    """(label_kind, label, n): settled jobs by kind, and pending jobs by what one manager can do.

    A pending job is charged to one cause: executor, then pool (None: any), then the least
    missing capability; a submitted job, and one being committed or cancelled, needs its
    executor only.  Where the definition is not readable, a submitted job may still
    register and is actionable; the others are counted as unreadable.
    """
    missing = F.array_min(F.array_except(name_set(F.col("capabilities")), F.array(*map(F.lit, offered)).cast("array<string>")))
    kind, pending, ending = F.col("kind"), F.col("kind").isin("submitted", "ready"), F.col("kind").isin("committing", "cancelling")
    wrong_pool = F.lit(False) if pools is None else ~F.col("pool").isin(*pools)
    charge = lambda label_kind, label: F.struct(F.lit(label_kind).alias("a"), label.cast("string").alias("b"))
    cause = (
        F.when(kind.isin("succeeded", "failed", "waiting", "paused"), charge("settled", kind))
        .when(~F.col("readable") & (kind == "submitted"), charge("actionable", kind))
        .when(~F.col("readable") & (pending | ending), charge("unreadable", kind))
        .when(pending & ~F.col("executor").isin(*executors), charge("executor", F.col("executor")))
        .when(kind == "submitted", charge("actionable", kind))
        .when((kind == "ready") & wrong_pool, charge("pool", F.col("pool")))
        .when((kind == "ready") & missing.isNotNull(), charge("capability", missing))
        .when(kind == "ready", charge("actionable", kind))
        .when(ending & F.col("executor").isin(*executors), charge("actionable", kind))
    )
    labelled = jobs.select(cause.alias("c")).where("c IS NOT NULL")
    return labelled.groupBy(F.col("c.a").alias("label_kind"), F.col("c.b").alias("label")).agg(F.count("*").alias("n"))


def attempt_history(frames: DataFrame) -> DataFrame:
    """Per job: distinct attempts and activations, last step, unclean restarts, last failure code, failed frames, newest generation."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("generation")))
    return frames.groupBy("job_id").agg(
        F.count_distinct("attempt_id").alias("n_attempts"),
        F.count_distinct("activation_id").alias("n_activations"),
        last("step").alias("last_step"),
        F.count_if("unclean_restart").alias("n_unclean"),
        last("failure_code").alias("last_failure"),
        F.count_if(F.col("kind") == "failed").alias("n_failed"),
        F.max("generation").alias("generation"),
    )


def flapping(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Jobs with more attempts than the limit, in all or in this activation, and no limits of their own."""
    tries = F.greatest(F.col("attempts"), F.col("total_attempts"))
    return jobs.where((tries > limit) & F.col("max_attempts").isNull() & F.col("max_total").isNull()).withColumn("tries", tries)


def gc_candidates(files: DataFrame, now: str, retention: dict[str, float | None]) -> DataFrame:
    """Files at or past the age that their category allows; categories without one keep all."""
    at = F.lit(now).cast("timestamp_ntz")
    tests = [(F.col("category") == c) & aged(F.col("mtime"), at, days) for c, days in retention.items()]
    keep = tests[0]
    for t in tests[1:]:
        keep = keep | t
    return files.where(keep)


def category_report(spark: SparkSession, candidates: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Every category in fixed order with its candidates and bytes, zeros included."""
    names = spark.createDataFrame([(i, c) for i, c in enumerate(categories)], "position int, category string")
    sums = candidates.groupBy("category").agg(F.count("*").alias("n"), F.sum("size_bytes").cast("decimal(20,2)").alias("size"))
    return names.join(sums, "category", "left").select(
        "position", "category", F.coalesce("n", F.lit(0)).alias("candidates"), F.coalesce(F.col("size"), F.lit(0).cast("decimal(20,2)")).cast("double").alias("bytes")
    )


def all_but_newest(files: DataFrame) -> DataFrame:
    """Files of each job that are not its newest by (mtime, name)."""
    newest_first = Window.partitionBy("job_id").orderBy(F.desc("mtime"), F.desc("name"))
    return files.withColumn("age_rank", F.row_number().over(newest_first).cast("long")).where("age_rank > 1")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def failure_summary(frames: DataFrame) -> DataFrame:
    """Failure codes with their jobs counted and the 10 least job ids, from distinct pairs."""
    pairs = frames.where("failure_code IS NOT NULL").select("failure_code", "job_id").distinct()
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("failure_code").orderBy("job_id")))
    first = ranked.where("r <= 10").groupBy("failure_code").agg(F.array_join(F.array_sort(F.collect_list("job_id")), ",").alias("first_jobs"))
    counts = pairs.groupBy("failure_code").agg(F.count("*").alias("n_jobs"))
    return counts.join(first, "failure_code")


def head_and_tail(rows: DataFrame, keys: Sequence[str], order: str, keep: int) -> DataFrame:
    """The first and last keep/2 rows of each group, with how many rows lie between."""
    up = Window.partitionBy(*keys).orderBy(F.asc(order))
    n = F.count("*").over(Window.partitionBy(*keys))
    numbered = rows.withColumn("position", F.row_number().over(up).cast("long")).withColumn("_n", n)
    half = keep // 2
    return (
        numbered.where((F.col("position") <= half) | (F.col("position") > F.col("_n") - (keep - half)))
        .withColumn("dropped", F.greatest(F.col("_n") - keep, F.lit(0)).cast("long"))
        .drop("_n")
    )


def tree_digest(files: DataFrame, key: str = "job_id") -> DataFrame:
    """A digest of each job's files that does not depend on row order; of one job's rows only."""
    entry = F.concat_ws("|", "name", "category", F.col("size_bytes").cast("decimal(20,2)").cast("string"))
    return files.groupBy(key).agg(
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(entry))), 256).alias("digest"), F.count("*").alias("n_files")
    )
