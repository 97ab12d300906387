"""What is recorded of a job, joined to its marker: definition, current state, history, report."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.folds import timeline_attempts
from ..operators.joins import children_by_label, with_frames
from ..operators.predicates import budget_exhausted, path_prefixes, runner_module
from ..sources.scratch import scratch_table

#: Members of a definition: column, path, type.
DEFINITION = (
    ("name", "$.name", "string"),
    ("workflow", "$.workflow", "string"),
    ("initial_step", "$.initial_step", "string"),
    ("runner_executor", "$.runner.executor", "string"),
    ("claim_pool", "$.claim.pool", "string"),
    ("max_attempts", "$.retry.attempts", "long"),
)


def load_jobs(markers: DataFrame, documents: DataFrame) -> DataFrame:
    """Markers with their definitions: the members of DEFINITION, digest, job_error.

    ``documents``: job_key (from the path), text (the stored JSON).  A definition is refused,
    and its members are null, where it is absent or no JSON object, where it names another
    job, or where the priority of a submitted marker is not its own.
    """
    parsed = documents.select(F.col("job_key").alias("_key"), F.sha2("text", 256).alias("_digest"), F.try_parse_json("text").alias("_document"))
    both = markers.join(parsed, F.col("job_key") == F.col("_key"), "left")
    member = lambda path, kind: F.try_variant_get("_document", path, kind)
    error = (
        F.when(F.col("_key").isNull(), "no job.json")
        .when(F.col("_document").isNull() | ~F.schema_of_variant("_document").startswith("OBJECT"), "job.json is not an object")
        .when(~member("$.job_key", "string").eqNullSafe(F.col("job_key")), "job.json names another job")
        .when((F.col("generation") == 0) & ~member("$.priority", "int").eqNullSafe(F.col("priority")), "job.json has another priority")
    )
    judged = both.withColumn("job_error", error)
    valid = lambda c: F.when(F.col("job_error").isNull(), c)
    members = [valid(member(path, kind)).alias(name) for name, path, kind in DEFINITION]
    return judged.select(*markers.columns, *members, valid(F.col("_digest")).alias("digest"), "job_error")


#: What a state frame says of itself besides its workspace.
STATE_FORMAT = {"format": "state", "format_version": 2}


def read_states(markers: DataFrame, frames: DataFrame, fields: list[str], workspace_id: str = "ws", format: Mapping[str, Any] = STATE_FORMAT) -> DataFrame:
    """Markers with their frame's kind, generation, priority and ``fields`` as ``state``, and state_error.

    A marker that refers to ``init`` has the virtual first frame: kind submitted, generation
    0, the marker's priority, and no other fields.  A frame that is absent, unreadable, or of
    another format, version, workspace, job key, generation or kind gives no state.
    """
    members = dict.fromkeys(["kind", "generation", "priority", *fields])
    have = lambda c: F.col(c) if c in frames.columns else F.lit(None).cast("int")
    named = frames.select(
        "record_ref", "is_error", F.col("job_key").alias("_key"), F.col("workspace_id").alias("_workspace"), *[F.col(c).alias(f"_{c}") for c in format],
        F.struct(*[have(c).alias(c) for c in members]).alias("_state"),
    )
    both = with_frames(markers, named)
    same = (F.col("_key") == F.col("job_key")) & (F.col("_workspace") == workspace_id) & (F.col("_state.generation") == F.col("generation")) & (F.col("_state.kind") == F.col("kind"))
    for c, value in format.items():
        same = same & (F.col(f"_{c}") == F.lit(value))
    error = (
        F.when(F.col("record_ref") == "init", None)
        .when(F.col("is_error").isNull(), "no such record")
        .when(F.col("is_error"), "record cannot be read")
        .when(~F.coalesce(same, F.lit(False)), "state frame disagrees with marker")
    )
    first = {"kind": F.lit("submitted"), "generation": F.lit(0), "priority": F.col("priority")}
    kinds = both.schema["_state"].dataType
    virtual = F.struct(*[first.get(c, F.lit(None)).cast(kinds[c].dataType).alias(c) for c in members])
    state = F.when(F.col("record_ref") == "init", virtual).when(error.isNull(), F.col("_state"))
    return both.select(*markers.columns, state.alias("state"), error.alias("state_error"))


def job_history(markers: DataFrame, frames: DataFrame) -> DataFrame:
    """(job_id, position, record_ref, error): the frames that each marker's chain of back-links reaches, oldest first.

    A record that is missing or unreadable ends the walk and is listed with its error, and a
    chain that comes back to itself ends with a row that says so.  Jumps of doubling length
    find a history of n frames in log2(n) rounds, whatever its records' generations say.
    """
    records = frames.select("record_ref", "previous_record_ref", "is_error")
    jump = scratch_table(records.where("NOT is_error AND previous_record_ref IS NOT NULL").select(F.col("record_ref").alias("at"), F.col("previous_record_ref").alias("to")))
    walked = scratch_table(markers.where("record_ref <> 'init'").select("job_id", "record_ref", F.lit(0).cast("long").alias("back")))
    n, before, length = walked.count(), -1, 1
    while n != before:
        further = walked.join(jump, F.col("record_ref") == F.col("at")).select("job_id", F.col("to").alias("record_ref"), (F.col("back") + length).alias("back"))
        walked = scratch_table(walked.unionByName(further).groupBy("job_id", "record_ref").agg(F.min("back").alias("back")))
        before, n = n, walked.count()
        if n != before:
            ahead = jump.select(F.col("at").alias("to"), F.col("to").alias("far"))
            jump, length = scratch_table(jump.join(ahead, "to").select("at", F.col("far").alias("to"))), 2 * length
    found = walked.join(records, "record_ref", "left")
    last = F.col("back") == F.max("back").over(Window.partitionBy("job_id"))
    error = F.when(F.col("is_error").isNull(), "no such record").when(F.col("is_error"), "record cannot be read")
    rows = found.select("job_id", "back", "record_ref", error.alias("error"), (last & F.col("previous_record_ref").isNotNull() & error.isNull()).alias("returns"), "previous_record_ref")
    cyclic = rows.where("returns").select("job_id", (F.col("back") + 1).alias("back"), F.col("previous_record_ref").alias("record_ref"), F.lit("the chain is cyclic").alias("error"))
    listed = rows.select("job_id", "back", "record_ref", "error").unionByName(cyclic)
    position = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("back"))).cast("long")
    return listed.select("job_id", position.alias("position"), "record_ref", "error")


def failure_of(code: Column, message: Column) -> tuple[Column, Column]:
    """(failure, damaged): a struct of code and message; a failure without a code is damaged."""
    recorded = code.isNotNull() | message.isNotNull()
    damaged = recorded & (code.isNull() | (code == ""))
    return F.when(recorded, F.struct(F.coalesce(code, F.lit("unknown")).alias("code"), message.alias("message"))), damaged


def records_of(markers: DataFrame, documents: DataFrame, frames: DataFrame, spawns: DataFrame, declarations: DataFrame) -> DataFrame:
    """The whole record of each marker's job: definition, state, attempts, children, declarations.

    Jobs without a usable definition have no record.  ``gaps`` is set where the state frame,
    a frame of the history or a declaration is damaged.  Inputs: ``frames`` with job_id and
    the fields of states; ``spawns`` as for ``children_by_label``; ``declarations``: job_id,
    declared, damaged.  Every side is folded to one row per job before it is joined.
    """
    defined = load_jobs(markers, documents).where("job_error IS NULL").drop("job_error")
    states = read_states(markers.select("job_id", "job_key", "kind", "generation", "record_ref", "priority"), frames, ["step", "attempt_id", "failure_code"])
    states = states.select("job_id", "state", "state_error")
    picked = defined.select("job_id")
    mine = frames.join(picked, "job_id", "left_semi")
    damage = mine.groupBy("job_id").agg(F.bool_or("is_error").alias("_damaged"), F.count("*").alias("n_frames"))
    tries = timeline_attempts(mine).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("activation_no", "attempt_no", "started_at", "finished_at", "failure_code", "outcome_action"))).alias("attempts")
    )
    named = children_by_label(spawns.join(picked, "job_id", "left_semi")).groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("first_position", "label", "child", "kind"))).alias("children")
    )
    declared = declarations.groupBy("job_id").agg(F.bool_or("damaged").alias("_undeclared"), F.array_sort(F.collect_set("declared")).alias("declarations"))
    joined = defined
    for side in (states, damage, tries, named, declared):
        joined = joined.join(side, "job_id", "left")
    gaps = F.col("state_error").isNotNull() | F.coalesce("_damaged", F.lit(False)) | F.coalesce("_undeclared", F.lit(False))
    return joined.withColumn("gaps", gaps).drop("_damaged", "_undeclared")


def describe_jobs(markers: DataFrame, documents: DataFrame, frames: DataFrame, budgets: DataFrame, headlines: DataFrame) -> DataFrame:
    """One report row per marker: identity, state, definition, budgets, owner, headline, and what could not be read.

    ``budgets``: job_id, attempts; ``headlines``: job_id, headline.  Jobs
    without definition or state stay, with job_error or state_error; an owner is shown for
    claimed, running and committing jobs only.
    """
    fields = ["step", "reason", "created_at", "activation_id", "attempt_id", "failure_code", "manager_id"]
    states = read_states(markers.select("job_id", "job_key", "kind", "generation", "record_ref", "priority"), frames, fields)
    wide = load_jobs(markers, documents).join(states.select("job_id", "state", "state_error"), "job_id").join(budgets, "job_id", "left").join(headlines, "job_id", "left")
    owned = F.col("kind").isin("claimed", "running", "committing")
    return wide.select(
        "job_id", "job_key", F.col("kind").alias("state_kind"), "placement", "priority", "generation", "record_ref",
        *[F.col(f"state.{c}").alias(c) for c in fields if c != "manager_id"],
        F.when(owned, F.col("state.manager_id")).alias("owner"),
        "name", "workflow", "initial_step", "digest",
        F.when(F.col("job_error").isNull(), budget_exhausted(F.col("attempts"), F.col("max_attempts"))).alias("budget_exhausted"),
        "headline", "job_error", "state_error",
    )


def step_findings(states: DataFrame) -> DataFrame:
    """(job_id, step, finding) of jobs whose next step is none of those that their runner recorded.

    ``states``: job_id, step, initial_step, runner_steps (array).  A job without recorded
    steps is never faulted; an empty step is the initial one.
    """
    step = F.coalesce(F.nullif("step", F.lit("")), F.col("initial_step"))
    known = F.col("runner_steps").isNotNull() & (F.size("runner_steps") > 0)
    text = F.concat(F.lit("step '"), step, F.lit("' is not one of the runner's recorded steps: "), F.array_join("runner_steps", ", "))
    return states.where(known & ~F.coalesce(F.array_contains("runner_steps", step), F.lit(False))).select("job_id", step.alias("step"), text.alias("finding"))


def decoded_layer(value: Column, declared: Column, layer: str) -> tuple[Column, Column]:
    """(value as JSON text, problem) of one environment layer's text under a declared type.

    A string is taken as it is, quoted; other types are JSON of that type (an integer or
    number is no boolean); no declared type leaves the text.
    """
    document = F.try_parse_json(value)
    kind = F.schema_of_variant(document)
    fits = (
        F.when(declared == "boolean", kind == "BOOLEAN")
        .when(declared == "integer", kind == "BIGINT")
        .when(declared == "number", kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
        .when(declared == "array", kind.startswith("ARRAY<"))
        .when(declared == "object", kind.startswith("OBJECT"))
    )
    raw = declared.isNull() | (declared == "string")
    problem = (
        F.when(value.isNull() | raw, None)
        .when(document.isNull(), F.concat(F.lit(f"{layer} is not JSON for type "), declared))
        .when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit(f"{layer} does not match type "), declared))
    )
    return F.when(raw, value).when(problem.isNull(), F.to_json(document)), problem


def environment_findings(wanted: DataFrame, layers: list[tuple[str, str]]) -> DataFrame:
    """(job_id, name, value, source, problem): the first layer that sets each variable, decoded and checked.

    ``wanted``: job_id, name, type and one text column per layer; ``layers`` pairs names with
    columns in order of precedence.  A layer that is set but does not fit is a problem and
    ends the search, as does a variable that no layer sets.
    """
    value = source = problem = None
    for name, column in layers:
        text, fault = decoded_layer(F.col(column), F.col("type"), name)
        there = F.col(column).isNotNull()
        pick = lambda old, new: F.when(there, new) if old is None else old.when(there, new)  # noqa: B023, E731
        value, source, problem = pick(value, text), pick(source, F.lit(name)), pick(problem, fault)
    return wanted.select("job_id", "name", value.alias("value"), source.otherwise("unresolved").alias("source"), problem.otherwise("no layer sets it").alias("problem"))


def products(outputs: DataFrame, inputs: DataFrame, roles: DataFrame) -> DataFrame:
    """Product links of collected runs: each fulfilled output role to the edge that it is a product of.

    ``outputs`` and ``inputs``: run_id, label, entry; ``roles``: run_id, role, product_of.  The
    source is the run's input edge of that label, else its own output edge; without either
    the link is unlinked (null source).  Roles that no output fulfils give no row.
    """
    out = outputs.select("run_id", F.col("label").alias("role"), F.col("entry").alias("target"))
    made = roles.where("product_of IS NOT NULL").join(out, ["run_id", "role"])
    given = inputs.select("run_id", F.col("label").alias("product_of"), F.col("entry").alias("_given"))
    own = outputs.select("run_id", F.col("label").alias("product_of"), F.col("entry").alias("_own"))
    linked = made.join(given, ["run_id", "product_of"], "left").join(own, ["run_id", "product_of"], "left")
    return linked.select("run_id", "role", "product_of", F.coalesce("_given", "_own").alias("source"), "target")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(run_id, inputs, artifacts, outputs): edges of each run by direction."""
    count = lambda d: F.count_if(F.col("direction") == d)
    return edges.groupBy("run_id").agg(count("input").alias("inputs"), count("artifact").alias("artifacts"), count("output").alias("outputs"))


def runner_provenance(jobs: DataFrame, packages: DataFrame) -> DataFrame:
    """(job_id, module, distribution, version): the installed package that holds each packaged runner's module.

    ``jobs``: job_id, runner; ``packages``: package, distribution, version.  Of packages that
    hold a module the innermost counts; a module of none has null ones, and runners that are
    not packaged give no row.  Modules meet packages by their prefixes, as equal names.
    """
    module = runner_module(F.col("runner"))
    named = jobs.select("job_id", module.alias("module")).where("module IS NOT NULL")
    held = named.withColumn("package", F.explode(F.transform(path_prefixes(F.replace("module", F.lit("."), F.lit("/"))), lambda p: F.replace(p, F.lit("/"), F.lit(".")))))
    found = held.join(packages, "package").groupBy("job_id").agg(F.max_by(F.struct("distribution", "version"), F.length("package")).alias("p"))
    return named.join(found, "job_id", "left").select("job_id", "module", "p.distribution", "p.version")
