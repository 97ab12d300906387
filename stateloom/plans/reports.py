"""Composed reports: why a job does not move, integrity, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import identity_mismatch, with_frames
from ..operators.predicates import area_of, budget_exhausted, depth_of, requirement_matches
from ..schemas import TERMINAL_KINDS

_WANTS = ["executor", "pool", "capabilities", "area"]


def explain_jobs(jobs: DataFrame, managers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per job: blocked or not, and the checks that say why, in fixed order.

    Checks depend on the kind: ready jobs need a manager and budget, waiting ones a verdict,
    running ones nothing here.  Terminal jobs are not blocked.
    """
    offers = requirement_matches(jobs.where("kind = 'ready'"), managers)
    wide = (
        jobs.withColumn("area", area_of(F.col("placement"), depth_of(managers)))
        .join(offers, _WANTS, "left")
        .join(verdicts.select(F.col("parent_id").alias("job_id"), "verdict"), "job_id", "left")
    )
    kind = F.col("kind")
    per_activation = budget_exhausted(F.col("attempts"), F.col("max_attempts"))
    in_total = budget_exhausted(F.col("total_attempts"), F.col("max_total"))
    checks = F.array_compact(
        F.array(
            F.when(kind == "submitted", "not registered"),
            F.when((kind == "ready") & (F.coalesce("n_eligible", F.lit(0)) == 0), "no manager could claim it"),
            F.when((kind == "ready") & per_activation, "attempts of this activation used up"),
            F.when((kind == "ready") & in_total, "total attempts used up"),
            F.when((kind == "waiting") & F.col("verdict").isNull(), "children unknown"),
            F.when((kind == "waiting") & (F.col("verdict") != "satisfied"), F.concat(F.lit("children "), "verdict")),
            F.when(kind == "paused", "paused by an operator"),
        )
    )
    blocked = (F.size(checks) > 0) & ~kind.isin(*TERMINAL_KINDS)
    return wide.select("job_id", "kind", blocked.alias("blocked"), F.array_join(checks, "; ").alias("checks"))


#: The identity of a frame, in the order in which it is checked.
IDENTITY = ("format", "format_version", "workspace_id", "job_id", "job_key", "kind", "generation")


def integrity(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """Markers against the frames that they refer to: the first field of IDENTITY that differs.

    Both sides have the fields of IDENTITY and record_ref; frames also is_error.  A marker
    that refers to ``init`` has no frame, and must be submitted at generation 0.
    """
    theirs = frames.select("record_ref", "is_error", *[F.col(c).alias(f"f_{c}") for c in IDENTITY])
    joined = with_frames(markers, theirs)
    mismatch = identity_mismatch([(c, F.col(c), F.col(f"f_{c}")) for c in IDENTITY])
    first = (F.col("kind") == "submitted") & (F.col("generation") == 0)
    finding = (
        F.when((F.col("record_ref") == "init") & first, "ok")
        .when(F.col("record_ref") == "init", "mismatch:init")
        .when(F.col("is_error").isNull(), "missing")
        .when(F.col("is_error"), "unreadable")
        .when(mismatch.isNotNull(), F.concat(F.lit("mismatch:"), mismatch))
        .otherwise("ok")
    )
    return joined.select("job_id", "generation", "kind", finding.alias("finding"))


def readiness(jobs: DataFrame, managers: DataFrame, declarations: DataFrame) -> DataFrame:
    """Per submitted or ready job: findings of several classes, any of which may hold."""
    pending = jobs.where(F.col("kind").isin("submitted", "ready")).withColumn("area", area_of(F.col("placement"), depth_of(managers)))
    offers = requirement_matches(pending, managers)
    wide = pending.join(offers, _WANTS, "left").join(declarations, "job_id", "left")
    return wide.select(
        "job_id",
        (F.coalesce("n_eligible", F.lit(0)) == 0).alias("no_manager"),
        (F.col("executor") != "path").alias("legacy_executor"),
        (F.col("declared").isNotNull() & F.col("observed").isNull()).alias("input_missing"),
        budget_exhausted(F.col("attempts"), F.col("max_attempts")).alias("budget_used"),
    )


def readiness_summary(findings: DataFrame) -> DataFrame:
    """Jobs per problem class; a job may count in several."""
    flags = ("no_manager", "legacy_executor", "input_missing", "budget_used")
    return findings.agg(F.count("*").alias("jobs"), *[F.count_if(f).alias(f) for f in flags])


def transfer_refusal(wanted: DataFrame, jobs: DataFrame, waiting_on: DataFrame, quiescent: Sequence[str], kinds: Sequence[str], placement: Column) -> DataFrame:
    """Per requested id the first reason why it is not transferred, or ``eligible``."""
    joined = wanted.join(jobs, "job_id", "left").join(waiting_on.select("job_id").distinct().withColumn("_held", F.lit(True)), "job_id", "left")
    reason = (
        F.when(F.col("kind").isNull(), "not found")
        .when(~F.col("kind").isin(*quiescent), "not quiescent")
        .when(~F.col("kind").isin(*kinds), "filtered by state")
        .when(~placement, "filtered by placement")
        .when(F.col("_held") | (F.col("kind") == "waiting"), "blocked by join")
        .otherwise("eligible")
    )
    return joined.select("job_id", reason.alias("reason"))


def finding_flags(findings: DataFrame) -> DataFrame:
    """(job_id, claim, language, inputs, step, environment, runner): which problems a precheck has found.

    ``findings``: job_id; claim, language and runner (structs with a status, null where not
    checked); inputs (array); step (text); environment (array of name, status);
    environment_problems (array).  A runner that was checked without a status is a problem.
    """
    is_problem = lambda c: F.coalesce(F.col(f"{c}.status") == "problem", F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    unresolved = F.coalesce(F.exists("environment", lambda e: F.coalesce(e["status"] == "unresolved", F.lit(False))), F.lit(False))
    return findings.select(
        "job_id",
        is_problem("claim").alias("claim"),
        is_problem("language").alias("language"),
        some("inputs").alias("inputs"),
        (F.coalesce("step", F.lit("")) != "").alias("step"),
        (unresolved | some("environment_problems")).alias("environment"),
        (F.col("runner").isNotNull() & (F.coalesce("runner.status", F.lit("problem")) == "problem")).alias("runner"),
    )
