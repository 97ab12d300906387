"""Why a job does or does not move: every check that applies to its state, and what they come to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import alive, area_of, budget_exhausted, least_prefixes, name_set, path_prefixes, runner_module
from ..schemas import LIVE_KINDS, TERMINAL_KINDS

# Names of checks, in the order in which they are listed, and the states that they are for.
CHECKS = {
    "state frame": None,
    "job definition": None,
    "pause requested": None,
    "commit": ("committing",),
    "operator": ("cancelling", "cancelled"),
    "fencing": ("cancelling",),
    "owning manager": LIVE_KINDS,
    "lease": LIVE_KINDS,
    "persistent takeover": ("running",),
    "termination evidence": ("cancelling",),
    "join condition": ("waiting",),
    "join child": ("waiting",),
    "failure": ("failed",),
    "dependency child": ("failed",),
    "claim pool": ("submitted", "ready"),
    "required capabilities": ("submitted", "ready"),
    "runner executor": ("submitted", "ready"),
    "registered manager": ("submitted", "ready", "committing", "waiting", "cancelling"),
    "eligible manager": ("submitted", "ready", "committing", "waiting", "cancelling"),
    "budget": ("ready",),
    "maintenance lock": ("ready",),
    "error breadcrumb": ("failed", "paused"),
    "operator continue": ("failed", "paused"),
    "attempt history": ("ready", "claimed", "running", "failed"),
    "flapping": ("ready", "claimed", "running", "failed"),
    "pending request": ("ready", "failed", "paused"),
    "retired request": ("ready", "failed", "paused"),
}
#: Where each check stands in the list.
ORDER = {name: i for i, name in enumerate(CHECKS)}
#: What a manager is asked for by a job that is to be claimed, and by one that only has to be served.
TO_CLAIM = ("executor", "owner_uid", "placement", "pool", "capabilities", "runner")
TO_SERVE = ("executor", "owner_uid", "placement")
#: The pool of managers that take any.
_ANY = "*"


def _prefixed(mark: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(mark), n))


def _accepted(needs: Sequence[str]) -> dict[str, Column]:
    """Per need the names (array) of which a manager has to offer one, from a job's columns."""
    module = runner_module(F.col("runner"))
    dotted = F.transform(path_prefixes(F.replace(module, F.lit("."), F.lit("/"))), lambda p: F.replace(p, F.lit("/"), F.lit(".")))
    every = {
        "executor": F.array("executor"),
        "owner_uid": F.array(F.col("owner_uid").cast("string")),
        "placement": path_prefixes(F.col("area")),
        "pool": F.array(F.lit(_ANY), F.col("pool")),
        "runner": F.when(module.isNotNull(), _prefixed("m:", F.filter(dotted, lambda p: p != "")))
        .when(F.col("runner") == "installed", F.array(F.lit("s")))
        .otherwise(F.array(F.lit(""))),
    }
    return {n: every[n] for n in needs if n in every}


def _offered(needs: Sequence[str]) -> dict[str, Column]:
    """Per need the names (array) that a manager offers, no two of which one job accepts."""
    none = F.array().cast("array<string>")
    prefixes = least_prefixes(name_set(F.col("placement_prefixes")))
    modules = least_prefixes(name_set(F.col("runner_modules")), ".")
    every = {
        "executor": name_set(F.col("executors")),
        "owner_uid": F.array(F.col("uid").cast("string")),
        "placement": F.when(F.size(prefixes) == 0, F.array(F.lit(""))).otherwise(prefixes),
        "pool": F.when(F.col("accept_any_pool"), F.array(F.lit(_ANY))).otherwise(name_set(F.col("pools"))),
        "capabilities": F.array(F.array_join(F.array_sort(name_set(F.col("capabilities"))), ",")),
        "runner": F.concat(F.array(F.lit("")), _prefixed("m:", modules), F.when(F.col("searches"), F.array(F.lit("s"))).otherwise(none)),
    }
    return {n: every[n] for n in needs}


def _exploded(rows: DataFrame, arrays: dict[str, Column], *keep: str) -> DataFrame:
    rows = rows.select(*keep, *[c.alias(f"_{n}") for n, c in arrays.items()])
    for n in arrays:
        rows = rows.withColumn(n, F.explode(f"_{n}"))
    return rows.select(*keep, *arrays)


def accepting_managers(jobs: DataFrame, managers: DataFrame, needs: Sequence[str], depth: int) -> DataFrame:
    """(job_id, n_accepting): how many of the managers meet all the ``needs`` of each job; jobs that none meets are left out.

    Jobs fold to classes of equal needs and managers to counts of equal offers; both become
    rows of names and are joined by equality, so no pair of a job and a manager is made.
    ``depth`` is the most components of any manager's placement prefix.
    """
    placed = jobs.withColumn("area", area_of(F.col("placement"), depth))
    by = [{"placement": "area"}.get(n, n) for n in needs]
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    keyed = placed.select("job_id", F.struct(*known).alias("want"))
    classes = keyed.select("want").distinct().select("want", "want.*")
    accepted = _exploded(classes, _accepted(needs), "want")
    folded = _exploded(managers, _offered(needs)).groupBy(*needs).agg(F.count("*").alias("n"))
    if "capabilities" in needs:
        # Which offers hold all required names: as many in common as there are.
        wanted = classes.select(F.col("want.capabilities").alias("need")).distinct().withColumn("names", name_set(F.col("need")))
        offers = folded.select(F.col("capabilities").alias("offer")).distinct()
        met = wanted.select("need", F.size("names").alias("of"), F.explode("names").alias("name")).join(offers.select("offer", F.explode(name_set(F.col("offer"))).alias("name")), "name")
        holds = met.groupBy("need", "offer").agg(F.count("*").alias("n"), F.max("of").alias("of")).where("n = of").select("need", "offer")
        # Who requires nothing takes every offer, so the counts fold over the offers.
        free = folded.groupBy(*[n for n in needs if n != "capabilities"]).agg(F.sum("n").alias("n")).withColumn("need", F.lit(""))
        held = folded.join(holds, folded["capabilities"] == holds["offer"]).groupBy("need", *[n for n in needs if n != "capabilities"]).agg(F.sum("n").alias("n"))
        folded = free.unionByName(held)
        accepted = accepted.withColumn("need", F.col("want.capabilities"))
        needs = ["need", *[n for n in needs if n != "capabilities"]]
    counted = accepted.join(folded, list(needs)).groupBy("want").agg(F.sum("n").alias("n_accepting"))
    return keyed.join(counted, "want").select("job_id", "n_accepting")


def _check(name: str, applies: Column, passed: Column | None, detail: Column) -> Column:
    """struct(position, name, passed, detail), or null where the check is not for the row."""
    kinds = CHECKS[name]
    wanted = F.coalesce(applies, F.lit(False)) & (F.col("kind").isin(*kinds) if kinds else F.lit(True))
    passed = F.lit(None).cast("boolean") if passed is None else passed
    return F.when(wanted, F.struct(F.lit(ORDER[name]).alias("position"), F.lit(name).alias("name"), passed.alias("passed"), detail.cast("string").alias("detail")))


def _of_limit(made: Column, limit: Column) -> Column:
    return F.concat_ws(" of ", F.coalesce(made, F.lit(0)).cast("string"), F.coalesce(limit.cast("string"), F.lit("unlimited")))


def _wide(jobs, states, managers, history, breadcrumbs, children, lease) -> tuple[DataFrame, int, int]:
    """One row per job with all that its own checks read; how many managers there are, and how many live."""
    prefix_depth = F.array_max(F.transform(F.split("placement_prefixes", ","), lambda p: F.size(F.split(p, "/"))))
    is_live = alive(F.col("heartbeat_age_seconds"), lease)
    totals = managers.agg(F.count("*").alias("n"), F.count_if(is_live).alias("live"), F.max(prefix_depth).alias("depth")).first()
    live, depth = managers.where(is_live), totals.depth or 1
    readable = jobs.where("job_error IS NULL")
    to_claim = accepting_managers(readable.where("kind = 'ready'"), live, TO_CLAIM, depth)
    to_serve = accepting_managers(readable.where(F.col("kind").isin("submitted", "committing", "waiting", "cancelling")), live, TO_SERVE, depth)
    observed = children.groupBy("parent_id").agg(
        F.count("*").alias("n_children"), F.count_if(F.coalesce("terminal", F.lit(False))).alias("n_terminal"), F.count_if(F.col("child_kind").isNull()).alias("n_unresolved")
    )
    owners = managers.select("manager_id", F.lit(True).alias("owner_known"), F.col("heartbeat_age_seconds").alias("owner_age"))
    wide = (
        jobs.join(states, "job_id", "left")
        .join(to_claim.unionByName(to_serve), "job_id", "left")
        .join(history.select("job_id", "n_attempts", "n_activations", "last_step", "n_unclean"), "job_id", "left")
        .join(breadcrumbs.select("job_id", F.struct("step", "exception", "message").alias("crumb")), "job_id", "left")
        .join(observed.withColumnRenamed("parent_id", "job_id"), "job_id", "left")
        .join(owners, "manager_id", "left")
        .withColumn("lease_seconds", F.coalesce(F.col("lease_seconds").cast("double"), F.lit(float(lease))))
    )
    wide = wide.withColumn("owner_alive", F.coalesce(F.col("owner_age") <= F.col("lease_seconds"), F.lit(False)))
    return wide, totals.n, totals.live


def _foreign(host: str) -> Column:
    """A running job whose owner's lease has expired and whose persistent folder was written on another host."""
    return (F.col("kind") == "running") & ~F.col("owner_alive") & F.col("job_error").isNull() & F.coalesce("persistent", F.lit(False)) & F.coalesce(F.col("writer_host") != host, F.lit(False))


def _over_budget() -> Column:
    return budget_exhausted(F.col("attempts"), F.col("max_attempts")) | budget_exhausted(F.col("total_attempts"), F.col("max_total"))


def job_checks(
    jobs: DataFrame, states: DataFrame, managers: DataFrame, history: DataFrame, children: DataFrame, requests: DataFrame, breadcrumbs: DataFrame,
    *, host: str, lease: float = 900.0, locked_by: str | None = None, flapping: int = 10,
) -> DataFrame:
    """(job_id, position, place, name, passed, detail): the checks of every job, in the order of CHECKS.

    ``passed`` is null for a check that only informs.  ``jobs``: job_id, kind, job_error, what
    a claim requires and its budgets; ``states``: job_id and what the current frame says;
    ``history`` as by ``attempt_history``; ``children``: parent_id, place, label, child_kind
    (null: not resolved), terminal, failure, observed (of a waiting job's join now) or not (as
    a failed job's record has them); ``requests``: job_id, request_id, action, operator,
    retired_at (null: pending), reason; ``breadcrumbs``: job_id, step, exception, message.
    Children and requests stay rows, so a job may have any number; where several requests
    were retired last at one time, the least request_id speaks.
    """
    wide, n_managers, n_live = _wide(jobs, states, managers, history, breadcrumbs, children.where("observed"), lease)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    here, good = F.lit(True), F.col("job_error").isNull()
    total, tried = F.col("total_attempts"), F.greatest(F.coalesce("attempts", F.lit(0)), F.coalesce("total_attempts", F.lit(0)))
    n = F.coalesce("n_accepting", F.lit(0))
    budgets = [("activation", F.col("attempts"), F.col("max_attempts")), ("total", total, F.col("max_total"))]
    spent = F.concat_ws("; ", *[F.concat(F.lit(f"{w} "), _of_limit(a, b)) for w, a, b in budgets])
    owner = F.when(F.col("manager_id").isNull(), "none recorded").when(F.col("owner_known").isNull(), F.concat(text("manager_id"), F.lit(" has no manifest"))).otherwise(
        F.concat(text("manager_id"), F.lit(" age "), text("owner_age"), F.lit(" lease "), F.col("lease_seconds").cast("long"))
    )
    continues = F.when(F.col("activation_id").isNull(), False).when(good, ~_over_budget())
    why = F.when(F.col("activation_id").isNull(), "no activation").when(~good, "budget unknown").otherwise(spent)
    own = [
        _check("state frame", F.col("state_error").isNotNull(), ~here, F.col("state_error")),
        _check("job definition", ~good, ~here, F.col("job_error")),
        _check("pause requested", F.col("pause_by").isNotNull() | F.col("pause_reason").isNotNull(), None, F.concat_ws(": ", text("pause_by"), text("pause_reason"))),
        _check("commit", F.col("wedge") != "", ~here, F.col("wedge")),
        _check("operator", here, None, F.concat_ws(": ", text("operator"), text("operator_reason"))),
        _check("fencing", here, here, F.lit("no later outcome applies")),
        _check("owning manager", here, F.col("owner_alive"), owner),
        _check("lease", F.col("owner_known") & ~F.col("owner_alive"), ~here, F.lit("expired")),
        _check("persistent takeover", _foreign(host), ~here, F.col("writer_host")),
        _check("termination evidence", here, None, text("evidence")),
        _check("join condition", here, None, F.concat_ws(" then ", text("condition"), text("next_step"))),
        _check("failure", F.col("failure_code").isNotNull(), ~here, F.concat_ws(": ", F.col("failure_code"), text("failure_message"))),
        _check("claim pool", good, None, F.col("pool")),
        _check("required capabilities", good, None, F.array_join(F.array_sort(name_set(F.col("capabilities"))), ",")),
        _check("runner executor", good, None, F.col("executor")),
        _check("registered manager", good & F.lit(n_live == 0), ~here, F.lit(f"{n_managers} registered, none alive")),
        _check("eligible manager", good & F.lit(n_live > 0), n > 0, F.concat(n.cast("string"), F.lit(f" of {n_live}"))),
        *[_check("budget", good, ~_over_budget(), F.concat(F.lit(f"{w} "), _of_limit(a, b))) for w, a, b in budgets],
        _check("maintenance lock", here, F.lit(locked_by is None), F.lit(locked_by or "none")),
        _check("error breadcrumb", here, F.when(F.col("crumb").isNotNull(), False), F.when(F.col("crumb").isNull(), "none").otherwise(F.concat(F.lit("step "), text("crumb.step"), F.lit(" raised "), text("crumb.exception"), F.lit(": "), text("crumb.message")))),
        _check("operator continue", here, continues, why),
        _check("attempt history", F.col("n_attempts") > 0, None, F.concat_ws(" ", F.col("n_attempts").cast("string"), F.lit("in"), F.col("n_activations").cast("string"), F.lit("at"), text("last_step"), F.lit("unclean"), F.col("n_unclean").cast("string"))),
        _check("flapping", good & F.col("max_attempts").isNull() & F.col("max_total").isNull() & (tried > flapping), ~here, tried),
    ]
    # Only the two budget lines share a position; the second has place 1.
    listed = wide.select("job_id", F.posexplode(F.array_compact(F.array(*own))).alias("_i", "c")).select("job_id", "c.*")
    listed = listed.withColumn("place", ((F.col("name") == "budget") & F.col("detail").startswith("total ")).cast("long"))
    kinds = jobs.select("job_id", "kind")
    born = children.withColumnRenamed("parent_id", "job_id").join(kinds, "job_id")
    describe = F.concat(text("label"), F.lit(" "), F.coalesce("child_kind", F.lit("unresolved")), F.coalesce(F.concat(F.lit(" "), F.col("failure")), F.lit("")))
    seen = born.where("observed").select("job_id", "place", _check("join child", here, F.coalesce("terminal", F.lit(False)), describe).alias("c"))
    bad = born.where(~F.col("observed") & ~F.col("child_kind").eqNullSafe("succeeded")).select("job_id", "place", _check("dependency child", here, ~here, describe).alias("c"))
    asked = requests.join(kinds, "job_id")
    pending = asked.where("retired_at IS NULL").select("job_id", F.lit(0).cast("long").alias("place"), _check("pending request", here, None, F.concat_ws(" ", F.col("request_id"), F.coalesce("action", F.lit("?")), F.lit("by"), text("operator"))).alias("c"))
    # Folded in two steps, each before its shuffle: the least id at each time, then the latest time.
    at_once = asked.where("retired_at IS NOT NULL").groupBy("job_id", "kind", "retired_at").agg(F.min_by(F.coalesce("reason", F.lit("unknown")), "request_id").alias("reason"))
    latest = at_once.groupBy("job_id", "kind").agg(F.max_by("reason", "retired_at").alias("reason"))
    gone = latest.select("job_id", F.lit(0).cast("long").alias("place"), _check("retired request", here, None, F.col("reason")).alias("c"))
    more = seen.unionByName(bad).unionByName(pending).unionByName(gone).where("c IS NOT NULL").select("job_id", "c.*", "place")
    return listed.unionByName(more).select("job_id", "position", "place", "name", "passed", "detail")


def job_diagnosis(
    jobs: DataFrame, states: DataFrame, managers: DataFrame, children: DataFrame, *, host: str, lease: float = 900.0, locked_by: str | None = None,
) -> DataFrame:
    """(job_id, kind, blocked, summary): whether each job stands still, and the one thing that it stands on.

    Inputs as for ``job_checks``.  A job that is done for, or that only an operator moves, is
    blocked, but for a succeeded one; a live one is where its owner's lease has expired.
    """
    owners = managers.select("manager_id", F.col("heartbeat_age_seconds").alias("owner_age"))
    observed = children.where("observed").groupBy(F.col("parent_id").alias("job_id")).agg(
        F.count("*").alias("n_children"), F.count_if(F.coalesce("terminal", F.lit(False))).alias("n_terminal"), F.count_if(F.col("child_kind").isNull()).alias("n_unresolved")
    )
    wide = jobs.select("job_id", "kind", "job_error").join(states, "job_id", "left").join(owners, "manager_id", "left").join(observed, "job_id", "left")
    wide = wide.withColumn("owner_alive", F.coalesce(F.col("owner_age") <= F.coalesce(F.col("lease_seconds").cast("double"), F.lit(float(lease))), F.lit(False)))
    kind, of, done = F.col("kind"), F.coalesce("n_children", F.lit(0)), F.coalesce("n_terminal", F.lit(0))
    wedged = F.coalesce(F.col("wedge") != "", F.lit(False))
    summary = (
        F.when(kind == "submitted", "not registered")
        .when(kind == "ready", "maintenance" if locked_by else "to be claimed")
        .when(kind.isin("claimed", "running") & F.col("owner_alive"), "progressing")
        .when(_foreign(host), F.concat(F.lit("written on "), F.col("writer_host")))
        .when(kind.isin("claimed", "running"), "to be recovered")
        .when(kind == "committing", F.when(wedged, "commit keeps failing").otherwise("to be committed"))
        .when((kind == "waiting") & (F.col("n_unresolved") > 0), F.concat(F.col("n_unresolved").cast("string"), F.lit(" unresolved, grace "), F.coalesce(F.concat(F.lit("since "), F.col("unresolved_since")), F.lit("not begun"))))
        .when((kind == "waiting") & (done < of), F.concat((of - done).cast("string"), F.lit(" of "), of.cast("string"), F.lit(" not terminal")))
        .when(kind == "waiting", F.when(of > 0, "to be joined").otherwise("no readable child"))
        .when(kind == "failed", F.coalesce(F.col("failure_code"), F.lit("no failure record")))
        .when(kind == "paused", "paused")
        .when(kind == "cancelling", "to be cancelled")
        .when(kind.isin(*TERMINAL_KINDS), "done")
        .otherwise("unknown state")
    )
    moves = (
        (kind == "succeeded")
        | (kind.isin("claimed", "running", "cancelling") & F.col("owner_alive"))
        | ((kind == "committing") & ~wedged)
        | ((kind == "waiting") & (of > 0) & (done == of))
    )
    return wide.select("job_id", "kind", (~moves).alias("blocked"), summary.alias("summary"))
