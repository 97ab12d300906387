"""Upkeep of a workspace: bounded scans, commits, children, sweeps, liveness of journals, old trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TERMINAL_KINDS
from ..sources.scratch import scratch_table

# Entries of a payload that no digest covers.
PRIVATE_NAME, PRIVATE_PREFIX = "job-state", "attempt."
# States of old task folders.
OLD_STATES = ("waitstart", "waitstep", "waitsubtasks", "running", "finished", "broken", "stopped", "timeout")


def is_private(name: Column, private: str = PRIVATE_NAME, prefix: str = PRIVATE_PREFIX) -> Column:
    """Whether a payload entry belongs to the runner alone."""
    return (name == private) | name.startswith(prefix)


def scan_order(markers: DataFrame) -> DataFrame:
    """Markers with ``place``, from 1: by kind, then placement component by component, then name.

    Components are compared one by one, so ``a.b`` stands after all of ``a/...``.  One range
    sort deals the markers over tasks, however many share a kind or a root; each row is
    numbered inside its range and shifted by the sizes of the ranges before it.  The sorted
    rows are written once, so that a rerun cannot deal them in another way.  Equal markers
    take neighbouring places.
    """
    row, low = "_row", (1 << 33) - 1
    # The number of a range stands in the upper bits, the place inside it in the lower.
    ordered = markers.orderBy("kind", F.split("placement", "/"), "job_key").withColumn(row, F.monotonically_increasing_id())
    table = scratch_table(ordered)
    part = F.shiftright(row, 33)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row for each range.
    begins = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_begin"))
    placed = table.join(begins, part == F.col("_part"))
    return placed.select(*markers.columns, (F.col("_begin") + F.col(row).bitwiseAND(low) + 1).alias("place"))


def bounded_scan(entries: DataFrame, cursors: DataFrame, rotation: str | None, processing: int, discovery: int) -> tuple[DataFrame, DataFrame]:
    """One window of a resumable scan: (markers taken, new cursors).

    ``entries``: root, position, included; ``cursors``: root, position (the last one seen).
    Roots are served in order from ``rotation`` on, each from behind its cursor, until
    ``discovery`` entries are visited or ``processing`` included ones are taken; entries at
    or before a cursor are not visited again.  A root that was read to its end has no
    cursor, so the next cycle starts it anew; the others keep theirs.  Only the least
    ``discovery`` entries in order are numbered.
    """
    after = cursors.select("root", F.col("position").alias("_after"))
    fresh = entries.join(after, "root", "left").where("_after IS NULL OR position > _after")
    order = [*([] if rotation is None else [F.col("root") < rotation]), F.col("root"), F.col("position")]
    window = fresh.orderBy(*order).limit(discovery)
    numbered = window.withColumn("_taken", F.sum(F.col("included").cast("int")).over(Window.orderBy(*order)))
    seen = numbered.where((F.col("_taken") < processing) | ((F.col("_taken") == processing) & F.col("included")))
    reached = seen.groupBy("root").agg(F.max("position").alias("_reached"))
    ends = fresh.groupBy("root").agg(F.max("position").alias("_end"))
    moved = ends.join(reached, "root", "left").join(after, "root", "full")
    open_ = F.col("_end").isNotNull() & (F.col("_reached").isNull() | (F.col("_reached") < F.col("_end")))
    kept = moved.where(open_).select("root", F.coalesce("_reached", "_after").alias("position")).where("position IS NOT NULL")
    return seen.where("included").select("root", "position"), kept


def next_root(entries: DataFrame, last: str) -> str | None:
    """The root to serve first after a window that ended in ``last``: the next by name, around the end."""
    row = entries.agg(F.min(F.when(F.col("root") > last, F.col("root"))).alias("n"), F.min("root").alias("first")).first()
    return row["first"] if row["n"] is None else row["n"]


def commit_outcomes(outcomes: DataFrame, states: DataFrame) -> DataFrame:
    """Published outcomes with ``fault`` (null: committed), one row per attempt, however often it is replayed.

    ``outcomes``: job_id, activation_id, attempt_id, action, published_at; ``states``: job_id,
    kind, activation_id, attempt_id of running and committing jobs.  Of an attempt's
    outcomes the first published counts.
    """
    first = outcomes.groupBy("job_id", "attempt_id").agg(F.min(F.struct("published_at", "activation_id", "action")).alias("o")).select("job_id", "attempt_id", "o.*")
    now = states.select("job_id", F.col("kind").alias("_kind"), F.col("activation_id").alias("_activation"), F.col("attempt_id").alias("_attempt"))
    fault = (
        F.when(F.col("_kind").isNull(), "no such job")
        .when(~F.col("_kind").isin("running", "committing"), "job is not running")
        .when(~F.col("activation_id").eqNullSafe(F.col("_activation")), "another activation")
        .when(~F.col("attempt_id").eqNullSafe(F.col("_attempt")), "another attempt")
        .when(F.col("action").isNull(), "no action")
    )
    return first.join(now, "job_id", "left").select("job_id", "attempt_id", "activation_id", "action", fault.alias("fault"))


def begin_commits(outcomes: DataFrame, spawns: DataFrame) -> DataFrame:
    """Accepted outcomes with what a committing frame records: action, and child digests and labels as maps.

    ``spawns``: job_id, child_key, label, digest.  A missing label, or one used twice, refuses the
    outcome (fault) before its job leaves running.
    """
    clash = spawns.groupBy("job_id", "label").agg(F.count("*").alias("n")).where("n > 1 OR label IS NULL").select("job_id").distinct().withColumn("_clash", F.lit(True))
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("child_key", c))))
    named = spawns.groupBy("job_id").agg(entry("digest").alias("child_digests"), entry("label").alias("child_labels"))
    both = outcomes.where("fault IS NULL").join(named, "job_id", "left").join(clash, "job_id", "left")
    return both.select("job_id", "attempt_id", F.col("action").alias("outcome_action"), "child_digests", "child_labels", F.when(F.col("_clash"), "child labels are missing or not unique").alias("fault"))


def children_to_register(spawns: DataFrame, bundles: DataFrame, markers: DataFrame) -> DataFrame:
    """Spawned children with ``fate``: changed, missing, registered, mismatch, publish or register.

    ``spawns``: job_id, child_key, digest (declared); ``bundles``: child_key, place (outcome or
    target), found (digest of what lies there); ``markers``: child_key.  A bundle that still
    lies in the outcome is looked at first: its digest must be the declared one, whether or
    not the child has a marker, and it is published and needs no second look.  Without one,
    what lies at the target must exist; a child with a marker is registered whatever its
    payload has become, and one without has to have the declared digest.
    """
    known = markers.select("child_key").distinct().withColumn("_there", F.lit(True))
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("found")))
    lying = bundles.groupBy("child_key").agg(at("outcome").alias("_outcome"), at("target").alias("_target"))
    both = spawns.join(lying, "child_key", "left").join(known, "child_key", "left")
    same = lambda c: F.coalesce(F.col(c) == F.col("digest"), F.lit(False))
    fate = (
        F.when(F.col("_outcome").isNotNull() & ~same("_outcome"), "changed")
        .when(F.col("_outcome").isNull() & F.col("_target").isNull(), "missing")
        .when(F.col("_there"), "registered")
        .when(F.col("_outcome").isNotNull(), "publish")
        .when(same("_target"), "register")
        .otherwise("mismatch")
    )
    return both.select("job_id", "child_key", fate.alias("fate"))


def deferred_pause(moves: DataFrame) -> DataFrame:
    """Moves with a sticky pause request applied at the boundary: next_kind, reason, who asked, pause_requested.

    ``moves``: job_id, next_kind, reason, pause_requested (struct of operator, reason and
    request_id, or null).  ready, waiting and paused become paused with the request consumed:
    the frame then says who asked (operator), why (operator_reason) and in which request
    (request_id).  Terminal kinds and cancelling drop it; other kinds carry it on.
    """
    asked, kind = F.col("pause_requested").isNotNull(), F.col("next_kind")
    boundary = kind.isin("ready", "waiting", "paused")
    return moves.select(
        "job_id",
        F.when(asked & boundary, "paused").otherwise(kind).alias("next_kind"),
        F.when(asked & boundary, "operator_pause_deferred").otherwise(F.col("reason")).alias("reason"),
        *[F.when(boundary, F.col(f"pause_requested.{c}")).alias(name) for name, c in (("operator", "operator"), ("operator_reason", "reason"), ("request_id", "request_id"))],
        F.when(boundary | kind.isin(*TERMINAL_KINDS, "cancelling"), None).otherwise(F.col("pause_requested")).alias("pause_requested"),
    )


def orphan_attempts(local: DataFrame, running: DataFrame, unreadable: DataFrame, uid: int) -> DataFrame:
    """Local attempts that no running marker names: attempt_id, job_key, act (reap, terminate, orphaned).

    ``local``: attempt_id, job_key, owner_uid, cancelling, fenced, exited.  Jobs whose state
    cannot be read, other users' attempts and those that a cancellation owns are left alone.
    """
    lost = local.join(running.select("attempt_id").distinct(), "attempt_id", "left_anti").join(unreadable.select("job_key").distinct(), "job_key", "left_anti")
    mine = lost.where((F.col("owner_uid").isNull() | (F.col("owner_uid") == uid)) & ~F.col("cancelling"))
    act = F.when(F.col("fenced"), F.when(F.col("exited"), "reap").otherwise("terminate")).otherwise("orphaned")
    return mine.select("attempt_id", "job_key", act.alias("act"))


def free_segments(segments: DataFrame, references: DataFrame, managers: DataFrame, lease: float) -> DataFrame:
    """Journal segments that nothing needs: no marker refers to them and no live manager writes them.

    ``segments``: writer, segment; ``references``: writer, segment of markers and of sealed
    bundles; ``managers``: writer (null: unknown), heartbeat_age_seconds.  A live manager whose writer is not
    known could write any, so then there are none.
    """
    live = managers.where(F.col("heartbeat_age_seconds") <= lease)
    unknown = live.agg(F.count_if(F.col("writer").isNull()).alias("n")).where("n > 0")
    held = segments.join(references.distinct(), ["writer", "segment"], "left_anti").join(live.where("writer IS NOT NULL").select("writer").distinct(), "writer", "left_anti")
    # One row at most: its presence empties the result.
    return held.join(F.broadcast(unknown.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left_anti")


def decided_joins(children: DataFrame, parents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Children whose result their parent's current activation has used, with what it saw.

    ``children``: job_id, parent_id, parent_key; ``parents``: parent_id, parent_key, kind,
    generation; ``summaries``: parent_id, job_id, observed_kind of the parent's current frame.
    """
    mine = children.join(parents.withColumnRenamed("kind", "parent_kind").withColumnRenamed("generation", "parent_generation"), ["parent_id", "parent_key"])
    return mine.join(summaries, ["parent_id", "job_id"]).select("job_id", "parent_id", "parent_kind", "parent_generation", "observed_kind")


def input_problems(declared: DataFrame, members: DataFrame) -> DataFrame:
    """(job_id, name, problem): required inputs whose destination is invalid or not in the payload.

    ``declared``: job_id, name, required, destination (null: not staged); ``members``: job_id, path.
    """
    staged = declared.where("required AND destination IS NOT NULL")
    path = F.col("destination")
    bad = (path == "") | path.startswith("/") | F.exists(F.split(path, "/"), lambda c: c.isin("", ".", ".."))
    found = members.select("job_id", F.col("path").alias("destination")).distinct().withColumn("_there", F.lit(True))
    both = staged.join(found, ["job_id", "destination"], "left")
    problem = F.when(bad, F.concat(F.lit("invalid destination "), path)).when(F.col("_there").isNull(), F.concat(F.lit("missing its staged destination "), path))
    return both.select("job_id", "name", problem.alias("problem")).where("problem IS NOT NULL")


def children_view(observed: DataFrame) -> DataFrame:
    """What a gathering step sees of its children, one row per parent: counts, labels in order, evidence by label.

    ``observed``: parent_id, position, label, job_id, kind.
    """
    by_place = F.array_sort(F.collect_list(F.struct("position", "label", "job_id", "kind")))
    packed = observed.groupBy("parent_id").agg(by_place.alias("all"))
    of = lambda *kinds: F.filter("all", lambda c: c["kind"].isin(*kinds))
    return packed.select(
        "parent_id",
        "all",
        of("succeeded").alias("succeeded"),
        of("failed", "cancelled").alias("failed"),
        F.transform(F.filter("all", lambda c: c["label"].isNotNull()), lambda c: c["label"]).alias("labels"),
    )


def tree_bytes(files: DataFrame, depth: int) -> DataFrame:
    """(tree, n_files, bytes) of every folder down to ``depth`` components below the root, by path prefix.

    ``files``: path, length.  Links have a null length and count nothing.
    """
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(0), F.least(F.lit(depth), F.size(parts) - 1))
    each = files.select("length", F.explode(F.transform(levels, lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("tree"))
    return each.groupBy("tree").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def globbed_outputs(runs: DataFrame, files: DataFrame, outputs: Column) -> DataFrame:
    """(run_id, port, paths, fault): output files by their patterns, sorted within each; the first, or all for an array.

    ``runs``: run_id, one row a run, and what ``outputs`` reads: array of (port, ordinal, pattern
    with ``*`` and ``?`` within a name, kind file or array, optional), a constant where all runs
    declare the same; ``files``: run_id, path.  Files meet patterns of their own run only, once
    the run's paths are one row: neither rules nor pairs of a file and a rule are shuffled or sorted.
    """
    def rule(pattern: Column) -> Column:
        quoted = F.regexp_replace(pattern, r"([.\\+()\[\]{}|^$])", r"\\$1")
        return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))

    port_of = lambda o: F.struct(o["port"].alias("port"), o["kind"].alias("kind"), o["optional"].alias("optional"))
    met = lambda o: F.transform(F.filter("_paths", lambda p: F.call_function("regexp_like", p, o["rule"])), lambda p: F.struct(o["ordinal"].alias("ordinal"), p.alias("path")))
    held = files.groupBy("run_id").agg(F.collect_list("path").alias("_paths"))
    each = runs.join(held, "run_id", "left").select("run_id", F.coalesce("_paths", F.array().cast("array<string>")).alias("_paths"), outputs.alias("_outputs"))
    each = each.select("*", F.explode(F.array_distinct(F.transform("_outputs", port_of))).alias("_port"))
    rules = F.transform(F.filter("_outputs", lambda o: port_of(o).eqNullSafe(F.col("_port"))), lambda o: F.struct(o["ordinal"].alias("ordinal"), rule(o["pattern"]).alias("rule")))
    found = each.select("run_id", "_port.*", F.transform(F.array_sort(F.flatten(F.transform(rules, met))), lambda x: x["path"]).alias("m"))
    fault = F.when((F.col("kind") != "array") & (F.size("m") == 0) & ~F.col("optional"), "matched nothing")
    return found.select("run_id", "port", F.when(F.col("kind") == "array", F.col("m")).otherwise(F.slice("m", 1, 1)).alias("paths"), fault.alias("fault"))


def extended_barriers(edges: DataFrame, finished: DataFrame, added: DataFrame) -> DataFrame:
    """Edges (parent, child, barrier) with the barriers that dynamic additions put before a node's dependents.

    ``finished``: node, change (replace, detour or addition); ``added``: node, new.  What a
    replacement or detour adds must settle before all dependents of the node; what an addition
    adds, before those for which the node is a barrier.
    """
    grown = finished.join(added, "node")
    waiting = edges.select(F.col("parent").alias("node"), "child", "barrier")
    new = waiting.join(grown, "node").where(F.col("barrier") | F.col("change").isin("replace", "detour"))
    return edges.select("parent", "child", "barrier").unionByName(new.select(F.col("new").alias("parent"), "child", F.lit(True).alias("barrier"))).distinct()


def old_tasks(folders: DataFrame) -> DataFrame:
    """Old task folders by name: path, and taskset, task_id, step, restarts, owner, priority, status.

    ``folders``: path.  Names are nine parts between dots.  Folders inside another task folder, and
    names of another form, are left out.
    """
    parts = F.split("path", "/")
    is_task = lambda name: name.startswith("ht.task.")
    outer = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), is_task)
    name = F.split(F.element_at(parts, -1), r"\.")
    fields = {"taskset": 2, "task_id": 3, "step": 4, "restarts": 5, "owner": 6, "priority": 7, "status": 8}
    part = lambda i: F.get(name, F.lit(i))
    formed = (
        (F.size(name) == 9) & (part(0) == "ht") & (part(1) == "task") & F.forall(name, lambda p: p != "")
        & part(5).rlike("^[0-9]+$") & part(7).rlike("^[1-5]$") & part(8).isin(*OLD_STATES)
    )
    return folders.where(~outer & F.coalesce(formed, F.lit(False))).select("path", *[part(i).alias(k) for k, i in fields.items()])


def finished_tasks(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Finished old tasks with their newest dated run: path, taskset, task_id, run, computed_at.

    ``runs``: path (of the task), run (folder name).  Tasks without a dated run are left out.
    """
    at = F.try_to_timestamp(F.regexp_extract("run", r"^ht\.run\.(\d{4}-\d{2}-\d{2}_\d{2}\.\d{2}\.\d{2})$", 1), F.lit("yyyy-MM-dd_HH.mm.ss"))
    dated = runs.withColumn("computed_at", at.cast("timestamp_ntz")).where("computed_at IS NOT NULL")
    newest = dated.groupBy("path").agg(F.max(F.struct("computed_at", "run")).alias("r"))
    return tasks.where("status = 'finished'").join(newest, "path").select("path", "taskset", "task_id", F.col("r.run").alias("run"), F.col("r.computed_at").alias("computed_at"))


def unfinished_tasks(tasks: DataFrame) -> DataFrame:
    """(status, n) of old tasks that are not finished."""
    return tasks.where("status <> 'finished'").groupBy("status").agg(F.count("*").alias("n"))
