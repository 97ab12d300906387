"""Joins of the recorded state: quantified child sets, as-of lookups, overlays, layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_job_key
from ..schemas import JOIN_CONDITIONS, LIVE_KINDS, TERMINAL_KINDS


def join_verdicts(joins: DataFrame, children: DataFrame) -> DataFrame:
    """satisfied, impossible or blocked for each parent's condition over its children.

    Satisfied is tested first.  One pre-aggregated pass over the children; parents without
    children drop out, so nothing is vacuously true.  A condition that is not one of the
    known ones has a null verdict.
    """
    done = F.col("kind").isin(*TERMINAL_KINDS)
    counted = children.groupBy("parent_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "succeeded").alias("good"),
        F.count_if(done).alias("done"),
    )
    n, good, done_n, k = F.col("n"), F.col("good"), F.col("done"), F.coalesce("k", F.lit(0))
    is_ = lambda c: F.col("cond") == c
    satisfied = (
        (is_("all_succeeded") & (good == n)) | (is_("all_terminal") & (done_n == n)) | (is_("any_succeeded") & (good > 0))
        | (is_("any_terminal") & (done_n > 0)) | (is_("at_least") & (good >= k))
    )
    impossible = (is_("all_succeeded") & (done_n > good)) | (is_("any_succeeded") & (done_n == n) & (good == 0)) | (is_("at_least") & (good + n - done_n < k))
    verdict = F.when(satisfied, "satisfied").when(impossible, "impossible").when(F.col("cond").isin(*JOIN_CONDITIONS), "blocked")
    return joins.join(counted, "parent_id").withColumn("verdict", verdict)


def join_outcomes(verdicts: DataFrame) -> DataFrame:
    """What a waiting parent does: advance, advance by on_impossible, fail, or wait."""
    outcome = (
        F.when(F.col("verdict") == "satisfied", "advance")
        .when((F.col("verdict") == "impossible") & F.col("has_on_impossible"), "advance_on_impossible")
        .when(F.col("verdict") == "impossible", "fail:dependency_failure")
        .otherwise("wait")
    )
    return verdicts.withColumn("outcome", outcome)


def first_unresolved(children: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per parent: children, the position of the first unresolved one (null: none), rows observed before it."""
    position = F.row_number().over(Window.partitionBy("parent_id").orderBy(*order))
    placed = children.withColumn("position", position)
    return placed.groupBy("parent_id").agg(
        F.count("*").alias("n"), F.min(F.when(~F.col("resolved"), F.col("position"))).cast("long").alias("first_missing")
    ).withColumn("observed", F.coalesce(F.col("first_missing") - 1, F.col("n")))


def unresolved_grace(elapsed: Column, grace: float = 3600.0) -> Column:
    """An unresolved child fails its parent once the elapsed time reaches the grace, inclusive."""
    return elapsed >= grace


def last_good_frame(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of: the newest readable frame strictly older than the marker's generation.

    ``max_by`` folds each side's frames before the shuffle; ties go to the later position.
    """
    older = markers.join(frames.where("NOT is_error"), "job_id").where("generation < marker_generation")
    best = older.groupBy("job_id").agg(F.max_by(F.struct("generation", "kind", "event_id"), F.struct("generation", "event_id")).alias("f"))
    return markers.join(best, "job_id", "left").select(
        "job_id", "marker_generation", F.col("f.generation").alias("generation"), F.col("f.kind").alias("kind"), F.col("f.event_id").alias("event_id")
    )


def live_owner(markers: DataFrame, frames: DataFrame, managers: DataFrame, lease: float) -> DataFrame:
    """Per marker of a live kind the newest readable frame whose manager is within its lease.

    The lease is the frame's own lease_seconds, else ``lease``.  Markers of other kinds, and
    those without such a frame, have no row.
    """
    live = markers.where(F.col("kind").isin(*LIVE_KINDS)).select("job_id")
    readable = frames.where("NOT is_error").join(live, "job_id", "left_semi")
    owned = readable.join(managers.select("manager_id", "heartbeat_age_seconds"), "manager_id").where(F.col("heartbeat_age_seconds") <= F.coalesce("lease_seconds", F.lit(lease)))
    best = owned.groupBy("job_id").agg(F.max_by(F.struct("generation", "manager_id"), "generation").alias("b"))
    return best.select("job_id", "b.generation", "b.manager_id")


def identity_mismatch(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """The name of the first pair of fields that differ, or null."""
    return F.coalesce(*[F.when(~a.eqNullSafe(b), F.lit(name)) for name, a, b in pairs])


def overlay_edges(base: DataFrame, owned: DataFrame, key: str = "label") -> DataFrame:
    """Keyed override in place, then what only the override has, both in their own order.

    Rows: key, position, value; result numbered from 1 over the ordered union.
    """
    b = base.select(key, F.col("position").alias("bp"), F.col("value").alias("bv"))
    o = owned.select(key, F.col("position").alias("op"), F.col("value").alias("ov"))
    return b.join(o, key, "full").select(
        key,
        F.when(F.col("bp").isNotNull(), F.col("bp")).otherwise(F.lit(1 << 40) + F.col("op")).alias("order"),
        F.coalesce("ov", "bv").alias("value"),
        F.when(F.col("op").isNull(), "base").when(F.col("bp").isNull(), "added").otherwise("replaced").alias("origin"),
    )


def layered(layers: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(value, source) of the first layer that is not null; source is ``unresolved`` if none is."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers], F.lit("unresolved"))
    return value, source


def declarations_merge(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Full outer merge, both sides side by side, and where the name was found."""
    merged = declared.join(observed, key, "full")
    found = F.when(F.col("declared").isNull(), "observed").when(F.col("observed").isNull(), "declared").otherwise("both")
    return merged.withColumn("found", found)


def transfer_selection(jobs: DataFrame, waiting_on: DataFrame, sealed: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Sealed jobs first, then live jobs of the kinds, each by placement and key.

    A live job is left out where it waits itself, where a waiting parent names it, or where
    it is sealed.
    """
    free = jobs.where(F.col("kind").isin(*kinds) & (F.col("kind") != "waiting"))
    live = free.join(sealed.select("job_id"), "job_id", "left_anti").join(waiting_on.select("job_id").distinct(), "job_id", "left_anti")
    pick = ["job_id", "job_key", "placement"]
    chosen = sealed.join(jobs, "job_id").select(*pick, F.lit("sealed").alias("origin")).unionByName(live.select(*pick, F.lit("live").alias("origin")))
    return chosen.orderBy(F.desc("origin"), "placement", "job_key")


def observe_join(references: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every child that a waiting job's join names, with what is known of it now.

    ``references``: parent_id, position, label, job_id, job_key, placement_hint; ``jobs``:
    job_id, job_key, placement, kind.  A child is looked up by key at the hinted placement,
    else by id; found nowhere, kind and terminal are null.  A reference with neither key
    nor id is reported as an error.
    """
    at = jobs.select(F.struct("job_id", "job_key", "placement", "kind").alias("hinted"), F.col("job_key").alias("job_key"), F.col("placement").alias("placement_hint"))
    named = jobs.select(F.struct("job_id", "job_key", "placement", "kind").alias("named"), "job_id")
    both = references.join(at, ["job_key", "placement_hint"], "left").join(named, "job_id", "left")
    found = F.coalesce("hinted", "named")
    lost = F.col("job_id").isNull() & F.col("job_key").isNull()
    return both.select(
        "parent_id", "position", "label", "job_id",
        F.coalesce(found["job_key"], F.col("job_key")).alias("job_key"),
        found["placement"].alias("placement"),
        found["kind"].alias("kind"),
        found["kind"].isin(*TERMINAL_KINDS).alias("terminal"),
        F.when(lost, "child reference is not an object").alias("error"),
    )


def labeled_join(references: DataFrame, spawned: DataFrame) -> DataFrame:
    """References of a join with missing labels filled in from the spawn set by job key.

    ``spawned``: parent_id, job_key, label; a label that is used twice within a parent's
    spawn set is an error.
    """
    twice = F.count("*").over(Window.partitionBy("parent_id", "label")) > 1
    checked = F.when(twice, F.raise_error(F.lit("a spawn label is used twice"))).otherwise(F.col("label"))
    labels = spawned.select("parent_id", "job_key", checked.alias("_label"))
    return references.join(labels, ["parent_id", "job_key"], "left").withColumn("label", F.coalesce("label", "_label")).select(*references.columns)


def child_evidence(children: DataFrame, frames: DataFrame, definitions: DataFrame) -> DataFrame:
    """Failure, work folder and data generation of terminal children, for the parent's next step.

    ``children``: child_id, kind, payload; ``frames``: the current frame of each child
    (child_id, attempt_id, workdir, failure_code, data_generation); ``definitions``:
    child_id, workdir_mode, workdir_path.  A persistent work folder is the declared one, an
    isolated one carries the attempt's id, and without a definition the recorded one stands.
    """
    known = children.join(frames, "child_id", "left").join(definitions, "child_id", "left")
    under = lambda path: F.concat_ws("/", "payload", path)
    folder = (
        F.when((F.col("workdir_mode") == "persistent"), under(F.col("workdir_path")))
        .when(F.col("workdir_mode").isNotNull() & F.col("attempt_id").isNotNull(), under(F.concat("workdir_path", F.lit("."), F.col("attempt_id").cast("string"))))
        .when(F.col("workdir").isNotNull(), under(F.col("workdir")))
    )
    failure = F.when(F.col("kind").isin("failed", "cancelled"), F.col("failure_code"))
    return known.select("child_id", "kind", failure.alias("failure_code"), folder.alias("workdir_path"), "data_generation")


def children_by_label(spawns: DataFrame) -> DataFrame:
    """Last spawn wins per (job, label): a changed child replaces the entry, an equal one updates its kind.

    ``spawns``: job_id, label, child, kind (nullable), position.  first_position keeps the
    order of first appearance.
    """
    by_label = Window.partitionBy("job_id", "label").orderBy("position")
    last = F.last("child").over(by_label.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    changed = F.coalesce((~F.lag("child").over(by_label).eqNullSafe(F.col("child"))).cast("int"), F.lit(1))
    runs = spawns.withColumn("_last", last).withColumn("_run", F.sum(changed).over(by_label))
    newest = F.max("_run").over(Window.partitionBy("job_id", "label"))
    return (
        runs.withColumn("_newest", newest)
        .groupBy("job_id", "label")
        .agg(
            F.max_by("child", "position").alias("child"),
            F.max_by("kind", F.when((F.col("_run") == F.col("_newest")) & F.col("kind").isNotNull(), F.col("position"))).alias("kind"),
            F.min("position").alias("first_position"),
        )
    )


def children_of(frames: DataFrame) -> DataFrame:
    """(job_id, label, child_id, child_key, kind, first_position) of the children that a job's frames name.

    ``frames``: job_id, generation, is_error, child_labels (map of job key to label: what an
    outcome spawned), join_children and join_summary (arrays of label, job_id, job_key,
    kind).  The three are read in that order, frame by frame; references without a label
    and unreadable frames name none.  A label whose child changes names the new one; one
    whose child is named again keeps it and takes over its kind, if it has one.
    """
    good = frames.where("NOT is_error")
    key_id = parse_job_key(F.col("_key"))["job_id"]
    spawned = good.select("job_id", "generation", F.posexplode(F.array_sort(F.map_entries("child_labels"))).alias("_at", "_e"))
    named = spawned.select("job_id", "generation", F.lit(0).alias("_source"), "_at", F.col("_e.value").alias("label"), F.col("_e.key").alias("_key")).select(
        "job_id", F.struct("generation", "_source", "_at").alias("position"), "label", key_id.alias("child_id"), F.col("_key").alias("child_key"), F.lit(None).cast("string").alias("kind")
    )
    for source, column in ((1, "join_children"), (2, "join_summary")):
        seen = good.select("job_id", "generation", F.posexplode(column).alias("_at", "_c"))
        named = named.unionByName(seen.select(
            "job_id", F.struct("generation", F.lit(source).alias("_source"), "_at").alias("position"), F.col("_c.label").alias("label"), F.col("_c.job_id").alias("child_id"), F.col("_c.job_key").alias("child_key"), F.col("_c.kind").alias("kind")
        ))
    rows = named.where("label <> ''")
    # The key of an entry is that of the row which began it.
    order = Window.partitionBy("job_id", "label").orderBy("position")
    begins = ~F.coalesce(F.lag(F.struct("child_id")).over(order).eqNullSafe(F.struct("child_id")), F.lit(False))
    runs = rows.withColumn("_begins", begins).withColumn("_run", F.sum(F.col("_begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entries = runs.groupBy("job_id", "label", "_run").agg(
        F.min_by(F.struct("child_id", "child_key"), "position").alias("_entry"),
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("position"))).alias("kind"),
        F.min("position").alias("_first"),
    )
    last = entries.groupBy("job_id", "label").agg(F.max_by(F.struct("_entry", "kind"), "_run").alias("_last"), F.min("_first").alias("first_position"))
    return last.select("job_id", "label", "_last._entry.child_id", "_last._entry.child_key", "_last.kind", "first_position")


#: Markers without a frame are dealt into so many parts.
_DEALT = 1 << 20


def with_frames(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """Markers with the frame of their record_ref, null where there is none; ``init`` names no frame.

    Most markers of a young campaign are ``init``.  They are dealt out by job instead of
    meeting in one task as equal keys.
    """
    ref = F.col("record_ref")
    dealt = markers.withColumn("_deal", F.when(ref == "init", 1 + F.pmod(F.xxhash64("job_id", "job_key"), F.lit(_DEALT))).otherwise(F.lit(0).cast("long")))
    held = frames.withColumn("_deal", F.when(ref == "init", F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    return dealt.join(held, ["record_ref", "_deal"], "left").drop("_deal")
