"""Ordered folds over a job's frames, as windows partitioned by job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _by_job() -> WindowSpec:
    return Window.partitionBy("job_id").orderBy("generation")


def transition_log(frames: DataFrame, start: str = "submitted") -> DataFrame:
    """Previous kind and kind of every frame; unreadable frames do not move the previous kind."""
    moved = F.last(F.when(~F.col("is_error"), F.col("kind")), ignorenulls=True).over(_by_job().rowsBetween(Window.unboundedPreceding, -1))
    return frames.select(
        "job_id", "generation", F.coalesce(moved, F.lit(start)).alias("from_kind"), F.when(~F.col("is_error"), F.col("kind")).alias("to_kind"), "is_error"
    )


def latest_frames(frames: DataFrame, n: int) -> DataFrame:
    """The newest n frames of each job, numbered from the oldest of them."""
    down = Window.partitionBy("job_id").orderBy(F.desc("generation"))
    kept = frames.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n)
    return kept.withColumn("position", F.row_number().over(_by_job()).cast("long")).drop("_r")


def activation_islands(frames: DataFrame) -> DataFrame:
    """Readable frames with the number of their activation within the job.

    Unreadable frames go first, so frames around one are adjacent.  A new island starts
    where the activation id differs from the one before; null equals null, and an id that
    comes back later opens another island.  Empty text ids count as null.
    """
    text = dict(frames.dtypes)["activation_id"] == "string"
    activation = F.nullif(F.col("activation_id"), F.lit("")) if text else F.col("activation_id")
    readable = frames.where("NOT is_error").withColumn("activation_id", activation)
    first = F.row_number().over(_by_job()) == 1
    starts = (first | ~F.lag("activation_id").over(_by_job()).eqNullSafe(F.col("activation_id"))).cast("int")
    return readable.withColumn("_starts", starts).withColumn("activation_no", F.sum("_starts").over(_by_job().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_starts")


def timeline_activations(frames: DataFrame) -> DataFrame:
    """One row per activation island: id, first and last generation, frames, and of its first frame time, kind, step, reason."""
    return (
        activation_islands(frames)
        .groupBy("job_id", "activation_no")
        .agg(
            F.min_by("activation_id", "generation").alias("activation_id"),
            F.min("generation").alias("first_generation"),
            F.max("generation").alias("last_generation"),
            F.count("*").alias("n_frames"),
            F.min_by("created_at", "generation").alias("started_at"),
            F.min_by("kind", "generation").alias("first_kind"),
            F.min_by("step", "generation").alias("step"),
            F.min_by("reason", "generation").alias("reason"),
        )
    )


def timeline_attempts(frames: DataFrame) -> DataFrame:
    """One row per attempt: opened by ``claimed``, followed by later frames with its attempt id.

    Frames before a claim, or with another attempt id, are ignored; a new activation closes
    the attempt.  The last ``running`` frame sets started_at, to its own started_at or else
    its time, and the last ``committing`` frame sets the outcome, even where these are null;
    of frames of other kinds the first with a time finishes it, and the first failure
    counts.  An empty attempt id is null.  Equal ids claimed twice are two attempts.
    """
    in_island = Window.partitionBy("job_id", "activation_no").orderBy("generation")
    claims = F.sum((F.col("kind") == "claimed").cast("int")).over(in_island.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    islands = activation_islands(frames)
    if dict(frames.dtypes)["attempt_id"] == "string":
        islands = islands.withColumn("attempt_id", F.nullif("attempt_id", F.lit("")))
    numbered = islands.withColumn("attempt_no", claims).where("attempt_no > 0")
    in_attempt = Window.partitionBy("job_id", "activation_no", "attempt_no").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    own = numbered.withColumn("_id", F.first("attempt_id").over(in_attempt)).where(F.col("attempt_id").eqNullSafe(F.col("_id")))
    closing = ~F.col("kind").isin("claimed", "running")
    at = lambda test: F.when(test, F.col("generation"))
    return own.groupBy("job_id", "activation_no", "attempt_no").agg(
        F.min_by("attempt_id", "generation").alias("attempt_id"),
        F.min("generation").alias("claim_generation"),
        F.max_by(F.coalesce("started_at", "created_at"), at(F.col("kind") == "running")).alias("started_at"),
        F.min_by("created_at", at(closing & F.col("created_at").isNotNull())).alias("finished_at"),
        F.min_by("failure_code", at(closing & F.col("failure_code").isNotNull())).alias("failure_code"),
        F.max_by("outcome_action", at(F.col("kind") == "committing")).alias("outcome_action"),
        F.count("*").alias("n_frames"),
    )


def carried_members(frames: DataFrame, member: str) -> DataFrame:
    """The member's value at each frame, inherited from the last frame of the activation that set it."""
    within = Window.partitionBy("job_id", "activation_no").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return activation_islands(frames).withColumn(member, F.last(member, ignorenulls=True).over(within))


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order; null keys are equal."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def round_robin(rows: DataFrame, root: str, order: str, last_served: str | None = None) -> DataFrame:
    """Rows in turns over the roots, starting after the last served one."""
    turn = F.row_number().over(Window.partitionBy(root).orderBy(order)).cast("long")
    later = F.lit(0) if last_served is None else F.when(F.col(root) > last_served, 0).otherwise(1)
    return rows.withColumn("turn", turn).withColumn("_later", later).orderBy("turn", "_later", root).drop("_later")


def with_places(rows: DataFrame, root: str, last_served) -> DataFrame:
    """Rows of ``round_robin`` with ``served``, their place from 1 in the order of service.

    Turns are counted first, then roots are numbered inside a turn, so only one row per turn
    meets in one task.
    """
    per_turn = rows.groupBy("turn").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_turn.select("turn", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    later = F.lit(0) if last_served is None else F.when(F.col(root) > last_served, 0).otherwise(1)
    inside = F.row_number().over(Window.partitionBy("turn").orderBy(later, root))
    return rows.withColumn("_at", inside).join(begins, "turn").withColumn("served", (F.col("_begin") + F.col("_at")).cast("long")).drop("_at", "_begin")
