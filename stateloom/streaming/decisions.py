"""Decisions of one scheduling pass as column expressions: commits, retries, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import action_class, retry_budget_available


def commit_decision(outcome: Column, retryable: Column, attempts: Column, total: Column, most: Column, most_total: Column, activations: Column, most_activations: Column) -> Column:
    """Next kind for a committed outcome.

    advance fails beyond the activations allowed; retry looks at the limit per activation
    only; a retryable failure looks at both limits.
    """
    over = F.coalesce(F.coalesce(activations, F.lit(0)) + 1 > most_activations, F.lit(False))
    may_retry = F.coalesce(attempts < most, F.lit(True))
    return (
        F.when(outcome == "succeed", "succeeded")
        .when(outcome == "wait", "waiting")
        .when(outcome == "pause", "paused")
        .when((outcome == "advance") & over, "failed")
        .when(outcome == "advance", "ready")
        .when((outcome == "retry") & may_retry, "ready")
        .when((outcome == "fail") & retryable & retry_budget_available(attempts, total, most, most_total), "ready")
        .otherwise("failed")
    )


def attempt_failure(code: Column, retry_on: Column) -> Column:
    """retry if the code is one to retry on, else failed."""
    return F.when(F.coalesce(F.array_contains(retry_on, code), F.lit(False)), "retry").otherwise("failed")


def release_claim(counter: Column) -> Column:
    return F.greatest(F.lit(0), counter - 1)


def sort_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Operator requests as apply, stale or invalid.

    requests: request_id, job_id, action, expected_generation; jobs: job_id, kind, generation.
    A request for another generation is stale, one that its state does not allow is invalid.
    """
    joined = requests.join(jobs.select("job_id", "kind", "generation"), "job_id", "left")
    fate = (
        F.when(F.col("kind").isNull() | action_class(F.col("action"), F.col("kind")).isNull(), "invalid")
        .when(F.col("expected_generation") != F.col("generation"), "stale")
        .otherwise("apply")
    )
    return joined.withColumn("fate", fate)


def abandoned(claimed: DataFrame, managers: DataFrame, lease: float) -> DataFrame:
    """Claimed jobs whose manager is unknown or past its lease."""
    live = managers.where(F.col("heartbeat_age_seconds") <= lease).select("manager_id")
    return claimed.join(live, "manager_id", "left_anti")


def silent_sources(last_line: DataFrame, now: Column, timeout_seconds: float) -> DataFrame:
    """Followed sources without a line for the timeout or longer."""
    return last_line.withColumn("silent", (F.unix_micros(now) - F.unix_micros("last_at")) / 1e6 >= timeout_seconds)
