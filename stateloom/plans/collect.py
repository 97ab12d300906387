"""Collected records: the star join of jobs, newest frame, history folds and declarations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import timeline_attempts
from ..operators.predicates import under_placement
from ..schemas import COLLECTABLE_KINDS


def collect_kinds(states: Sequence[str]) -> tuple[str, ...]:
    """Distinct states in the given order; none, or one that is not stopped, is an error."""
    kinds = tuple(dict.fromkeys(states))
    if not kinds or any(k not in COLLECTABLE_KINDS for k in kinds):
        raise ValueError(f"collect takes one or more of {', '.join(COLLECTABLE_KINDS)}")
    return kinds


def collect_records(jobs: DataFrame, frames: DataFrame, states: Sequence[str] = ("succeeded",), placement: str = "") -> DataFrame:
    """One row per stopped job: its columns, history (its attempts, nested), counts, and whether its history has gaps.

    Jobs without frames stay, with no attempts.  History is filtered to the picked jobs
    before it is folded.
    """
    picked = jobs.where(F.col("kind").isin(*collect_kinds(states)) & under_placement(F.col("placement"), placement))
    history = frames.join(picked.select("job_id"), "job_id", "left_semi")
    gaps = history.groupBy("job_id").agg(F.max("is_error").alias("gaps"), F.count("*").alias("n_frames"))
    attempts = timeline_attempts(history).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("activation_no", "attempt_no", "attempt_id", "started_at", "finished_at", "failure_code", "outcome_action"))).alias("history")
    )
    joined = picked.join(gaps, "job_id", "left").join(attempts, "job_id", "left")
    none = F.array().cast(attempts.schema["history"].dataType)
    return joined.withColumn("history", F.coalesce("history", none)).withColumn("gaps", F.coalesce("gaps", F.lit(False))).withColumn("n_frames", F.coalesce("n_frames", F.lit(0)))


def record_summary(records: DataFrame) -> DataFrame:
    """Flat measures of the nested records."""
    failures = F.filter("history", lambda a: a["failure_code"].isNotNull())
    return records.select(
        "job_id", "kind", "n_frames", "gaps",
        F.size("history").cast("long").alias("n_attempts"),
        F.size(failures).cast("long").alias("n_failures"),
        F.array_max(F.transform("history", lambda a: a["finished_at"])).alias("last_finished"),
    )


def collect_summary(records: DataFrame) -> DataFrame:
    """One row: records, degraded ones (gaps or no history), attempts, failures."""
    flat = record_summary(records)
    return flat.agg(
        F.count("*").alias("collected"),
        F.count_if(F.col("gaps") | (F.col("n_frames") == 0)).alias("degraded"),
        F.coalesce(F.sum("n_attempts"), F.lit(0)).alias("attempts"),
        F.coalesce(F.sum("n_failures"), F.lit(0)).alias("failures"),
    )


def run_collector(records: DataFrame, collector: Callable[[dict], dict], schema: str, key: str = "job_id") -> DataFrame:
    """A user's function over records, batch by batch; a row whose call fails is kept with its error.

    ``schema`` lists the collector's outputs; the result has key, outputs, error.
    """
    kind = records.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    made, error = collector(record), None
                except Exception as e:  # noqa: BLE001  a collector may raise anything; its row degrades
                    made, error = {}, f"{type(e).__name__}: {e}"
                rows.append((record[key], *(made.get(n) for n in names), error))
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    return records.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def campaign(partitions: dict[str, DataFrame]) -> DataFrame:
    """All partitions in name order, each row with its partition."""
    out = None
    for name in sorted(partitions):
        part = partitions[name].withColumn("partition", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("a campaign has at least one partition")
    return out


def run_edges(observed: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """The observed document whole where there is one, else the declared one; both as variants."""
    both = observed.select(key, F.col("document").alias("o")).join(declared.select(key, F.col("document").alias("d")), key, "full")
    return both.select(key, F.coalesce("o", "d").alias("document"), F.when(F.col("o").isNotNull(), "observed").otherwise("declared").alias("origin"))
