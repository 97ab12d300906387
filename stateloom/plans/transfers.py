"""What may be handed to another workspace: sealed bundles first, then live jobs; and why others may not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import under_placement
from ..schemas import QUIESCENT_KINDS


def _sealed(ledgers: DataFrame, destination: str) -> DataFrame:
    return ledgers.where((F.col("status") == "sealed") & (F.col("destination_workspace_id") == destination))


def _first(ledgers: DataFrame) -> DataFrame:
    """Each job's ledger of the least transfer_id."""
    rest = [c for c in ledgers.columns if c != "job_id"]
    return ledgers.groupBy("job_id").agg(F.min_by(F.struct(*rest), "transfer_id").alias("_l")).select("job_id", "_l.*")


def transfer_candidates(
    jobs: DataFrame, ledgers: DataFrame, referenced: DataFrame, destination: str, states: Sequence[str],
    *, placement: str = "", remote: str | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """(job_id, job_key, kind, placement, origin, problem) of what may be offered to ``destination``, by placement and key.

    A job that is sealed for the destination is offered as its bundle (the ledger of the
    least transfer_id that the filters leave), any other as it lives.  ``ledgers``: job_id,
    transfer_id, job_key, status, destination_workspace_id, destination_remote (null fits any
    remote), prior_kind, placement, has_bundle, problem (what is wrong with its manifest or
    definition).  ``jobs``: job_id, job_key, kind, placement, problem.  ``referenced``: job_id
    of jobs that a waiting join names; these and waiting jobs do not go.  A candidate with a
    problem is listed with it.  ``wanted`` restricts to its job_ids.
    """
    kinds = tuple(dict.fromkeys(states))
    if not kinds or any(k not in QUIESCENT_KINDS for k in kinds):
        raise ValueError(f"an offer takes one or more of {', '.join(QUIESCENT_KINDS)}")
    to_remote = F.coalesce(F.col("destination_remote") == remote, F.lit(True)) if remote is not None else F.lit(True)
    inside = under_placement(F.col("placement"), placement)
    sealed = _sealed(ledgers, destination).where(to_remote & F.col("prior_kind").isin(*kinds) & inside & F.col("has_bundle"))
    live = jobs.where(F.col("kind").isin(*kinds) & (F.col("kind") != "waiting") & inside)
    if wanted is not None:
        sealed, live = (d.join(wanted.select("job_id"), "job_id", "left_semi") for d in (sealed, live))
    sealed = _first(sealed)
    live = live.join(sealed.select("job_id"), "job_id", "left_anti").join(referenced.select("job_id"), "job_id", "left_anti")
    of = lambda kind, origin: ["job_id", "job_key", F.col(kind).alias("kind"), "placement", F.lit(origin).alias("origin"), "problem"]
    return sealed.select(*of("prior_kind", "sealed")).unionByName(live.select(*of("kind", "live"))).orderBy("placement", "job_key")


def transfer_reasons(
    wanted: DataFrame, jobs: DataFrame, ledgers: DataFrame, referenced: DataFrame, destination: str, states: Sequence[str], *, placement: str = "", remote: str | None = None
) -> DataFrame:
    """(job_id, reason) for every wanted id: ``eligible``, its candidate's problem, or the first rule that keeps it back.

    A job that lives is judged by its state, placement and joins.  One that does not is
    judged by its first sealed ledger for the destination, whatever its remote: outside the
    placement it is filtered, else its bundle is unavailable, also where its state is not
    asked for (so does the recorded behaviour).
    """
    asked = wanted.select("job_id").distinct()
    found = transfer_candidates(jobs, ledgers, referenced, destination, states, placement=placement, remote=remote, wanted=asked)
    found = found.groupBy("job_id").agg(F.max(F.struct(F.lit(True).alias("found"), "problem")).alias("_c"))
    alive = jobs.select("job_id", "kind", under_placement(F.col("placement"), placement).alias("_inside"))
    sealed = _first(_sealed(ledgers, destination).join(asked, "job_id", "left_semi"))
    sealed = sealed.select("job_id", (F.col("prior_kind").isin(*states) & ~under_placement(F.col("placement"), placement)).alias("_outside"))
    held = referenced.select("job_id").distinct().withColumn("_held", F.lit(True))
    both = asked.join(alive, "job_id", "left").join(sealed, "job_id", "left").join(held, "job_id", "left").join(found, "job_id", "left")
    reason: Column = (
        F.when(F.col("_c.problem").isNotNull(), F.col("_c.problem"))
        .when(F.col("_c.found"), "eligible")
        .when(F.col("kind").isNotNull() & ~F.col("kind").isin(*QUIESCENT_KINDS), "not quiescent")
        .when(F.col("kind").isNotNull() & ~F.col("kind").isin(*states), "filtered by state")
        .when(F.col("kind").isNotNull() & ~F.col("_inside"), "filtered by placement")
        .when(F.col("kind").isNotNull() & (F.col("_held") | (F.col("kind") == "waiting")), "blocked by join")
        .when(F.col("kind").isNotNull(), "not eligible")
        .when(F.col("_outside"), "filtered by placement")
        .when(F.col("_outside").isNotNull(), "bundle unavailable")
        .otherwise("not found")
    )
    return both.select("job_id", reason.alias("reason"))
