"""Filters and decisions over jobs: placement, eligibility, budgets, leases, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import under_placement
from ..schemas import ACTION_KINDS


def name_set(text: Column) -> Column:
    """The distinct names of a comma list; an empty text is the empty set."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, ",")))


def list_jobs(jobs: DataFrame, frames: DataFrame | None = None, kinds: Sequence[str] = (), placement: str = "") -> DataFrame:
    """Jobs of the given kinds under a placement, with the kind of their newest frame, sorted."""
    picked = jobs.where(under_placement(F.col("placement"), placement))
    if kinds:
        picked = picked.where(F.col("kind").isin(*kinds))
    if frames is not None:
        frames = frames.join(picked.select("job_id"), "job_id", "left_semi")
        newest = frames.groupBy("job_id").agg(F.max_by("kind", "generation").alias("frame_kind"), F.max("generation").alias("frame_generation"))
        picked = picked.join(newest, "job_id", "left")
    return picked.orderBy("placement", "job_key")


def eligible_ready(jobs: DataFrame, executors: Sequence[str], pools: Sequence[str] | None, offered: Sequence[str]) -> DataFrame:
    """Ready jobs that one manager may claim: executor served, pool served (None: any), required within offered."""
    missing = F.array_except(name_set(F.col("capabilities")), F.array(*map(F.lit, offered)).cast("array<string>"))
    pool = F.lit(True) if pools is None else F.col("pool").isin(*pools)
    return jobs.where((F.col("kind") == "ready") & F.col("executor").isin(*executors) & pool & (F.size(missing) == 0))


def claim_order(eligible: DataFrame, slots: int) -> DataFrame:
    """The first ``slots`` jobs by priority, then path, numbered from 1.

    The cut is a top-k (a bounded heap in every task); only the k rows left are numbered.
    """
    top = eligible.orderBy("priority", "placement", "job_key").limit(slots)
    return top.withColumn("slot", F.row_number().over(Window.orderBy("priority", "placement", "job_key")).cast("long"))


def path_prefixes(path: Column) -> Column:
    """The empty path and every component-wise prefix of a path, itself included."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def least_prefixes(paths: Column, separator: str = "/") -> Column:
    """Paths (array) without those that lie under another of them."""
    under = lambda p: F.exists(paths, lambda q: p.startswith(F.concat(q, F.lit(separator))))
    return F.array_distinct(F.filter(paths, lambda p: ~under(p)))


def runner_module(runner: Column) -> Column:
    """The module of a packaged runner ``pkg:module``, else null."""
    return F.when(runner.startswith("pkg:"), F.substring(runner, 5, 1 << 20))


def refusals() -> Column:
    """Reasons, in fixed order, why a manager (columns m_...) would not claim a job; both in one row.

    Owner, executor, one of several pools, capabilities, one of several placement prefixes
    compared by components, and the reach of an installed runner.  Empty lists of pools or
    capabilities offer none; an empty list of prefixes restricts nothing.
    """
    missing = F.array_sort(F.array_except(name_set(F.col("capabilities")), name_set(F.col("m_capabilities"))))
    prefixes, allowed = name_set(F.col("m_placement_prefixes")), name_set(F.col("m_runner_modules"))
    covered = (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: (F.col("placement") == p) | F.col("placement").startswith(F.concat(p, F.lit("/"))))
    module = runner_module(F.col("runner"))
    admitted = F.exists(allowed, lambda p: (module == p) | module.startswith(F.concat(p, F.lit("."))))
    reasons = [
        F.when(F.col("owner_uid") != F.col("m_uid"), F.concat(F.lit("owner "), F.col("owner_uid").cast("string"))),
        F.when(~F.array_contains(name_set(F.col("m_executors")), F.col("executor")), F.concat(F.lit("executor "), "executor")),
        F.when(~F.col("m_accept_any_pool") & ~F.array_contains(name_set(F.col("m_pools")), F.col("pool")), F.concat(F.lit("pool "), "pool")),
        F.when(F.size(missing) > 0, F.concat(F.lit("capabilities "), F.array_join(missing, ","))),
        F.when(~covered, F.concat(F.lit("placement "), "placement")),
        F.when(module.isNotNull() & ~admitted, F.concat(F.lit("runner module "), module)),
        F.when((F.col("runner") == "installed") & ~F.col("m_searches"), F.lit("runner search path")),
    ]
    return F.array_compact(F.array(*reasons))


def pair_refusals(pairs: DataFrame, jobs: DataFrame, managers: DataFrame) -> DataFrame:
    """The pairs (job_id, manager_id) with reasons; a pair whose job or manager is unknown drops out."""
    offers = managers.select("manager_id", *[F.col(c).alias(f"m_{c}") for c in ("uid", "executors", "pools", "accept_any_pool", "capabilities", "placement_prefixes", "runner_modules", "searches")])
    return pairs.join(jobs, "job_id").join(offers, "manager_id").withColumn("reasons", refusals())


#: What a claim requires, in the order of the bits of a mask.
REQUIREMENTS = ("executor", "pool", "capabilities", "placement")


def _masked(rows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    """Arrays of acceptable names exploded, once for every subset of REQUIREMENTS; others are empty."""
    for name in names:
        rows = rows.withColumn(name, F.explode(name))
    rows = rows.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(names) - 1))))
    masked = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(n)).otherwise("").alias(n) for i, n in enumerate(names)]
    return rows.select(*keep, "mask", *masked)


def requirement_matches(jobs: DataFrame, managers: DataFrame) -> DataFrame:
    """Per distinct requirement of jobs (executor, pool, capabilities, area): n_eligible, manager_id.

    n_eligible counts the managers that meet all four; manager_id is the least of those that
    meet most of them.  Both sides become rows of names per subset of requirements, managers
    are folded to one row per combination of names, and the two are joined by equality: no
    pair of a class and a manager is ever made.  area is the placement, as deep as any
    manager's prefix.
    """
    depth = depth_of(managers)
    wants = jobs.select("executor", "pool", "capabilities", area_of(F.col("placement"), depth).alias("area")).distinct()
    offered = managers.select(name_set(F.col("capabilities")).alias("have")).distinct().withColumn("offer", F.array_join(F.array_sort("have"), ","))
    # Which offers hold a non-empty set of required capabilities: as many names in common as it has.
    needs = wants.select("capabilities").distinct().withColumn("need", name_set(F.col("capabilities")))
    shared = needs.withColumn("name", F.explode("need")).join(offered.withColumn("name", F.explode("have")), "name")
    holds = shared.groupBy("capabilities", "offer").agg(F.count("*").alias("n"), F.max(F.size("need")).alias("of")).where("n = of").select("capabilities", "offer")
    # A row for every offer that holds what is required, never a list of them.
    keys = wants.join(holds, "capabilities", "left").select(
        F.struct("executor", "pool", "capabilities", "area").alias("want"),
        F.array("executor").alias("executor"),
        F.array(F.lit("*"), "pool").alias("pool"),
        F.array(F.when(F.col("capabilities") == "", "").otherwise(F.coalesce("offer", F.lit("?")))).alias("capabilities"),
        path_prefixes(F.col("area")).alias("placement"),
    )
    prefixes = least_prefixes(name_set(F.col("placement_prefixes")))
    offers = managers.select(
        "manager_id",
        name_set(F.col("executors")).alias("executor"),
        F.when(F.col("accept_any_pool"), F.array(F.lit("*"))).otherwise(F.coalesce(F.nullif(name_set(F.col("pools")), F.array().cast("array<string>")), F.array(F.lit("?")))).alias("pool"),
        F.array_distinct(F.array(F.lit(""), F.array_join(F.array_sort(name_set(F.col("capabilities"))), ","))).alias("capabilities"),
        F.when(F.size(prefixes) == 0, F.array(F.lit(""))).otherwise(prefixes).alias("placement"),
    )
    by = ["mask", *REQUIREMENTS]
    folded = _masked(offers, REQUIREMENTS, "manager_id").groupBy(*by).agg(F.min("manager_id").alias("manager_id"), F.count("*").alias("n"))
    found = _masked(keys, REQUIREMENTS, "want").distinct().join(folded, by)
    met, all_ = F.bit_count("mask"), 2 ** len(REQUIREMENTS) - 1
    best = found.groupBy("want").agg(
        F.min_by("manager_id", F.struct(-met, "manager_id")).alias("manager_id"),
        F.coalesce(F.sum(F.when(F.col("mask") == all_, F.col("n"))), F.lit(0)).alias("n_eligible"),
    )
    return best.select("want.*", "manager_id", "n_eligible")


def depth_of(managers: DataFrame) -> int:
    """The most components of any manager's placement prefix."""
    return managers.agg(F.max(F.array_max(F.transform(F.split("placement_prefixes", ","), lambda p: F.size(F.split(p, "/")))))).first()[0] or 1


def area_of(placement: Column, depth: int) -> Column:
    return F.substring_index(placement, "/", depth)


def closest_manager(jobs: DataFrame, managers: DataFrame) -> DataFrame:
    """Per ready job the manager that meets most of its requirements (least id on ties), why it may
    still refuse, and how many managers meet all four."""
    ready = jobs.where("kind = 'ready'")
    best = requirement_matches(ready, managers)
    placed = ready.withColumn("area", area_of(F.col("placement"), depth_of(managers)))
    pairs = placed.join(best, ["executor", "pool", "capabilities", "area"]).select("job_id", "manager_id", "n_eligible")
    return pair_refusals(pairs, ready, managers).select(
        "job_id", "n_eligible", "manager_id", F.size("reasons").cast("long").alias("n_reasons"), F.array_join("reasons", "; ").alias("reasons")
    )


def alive(age: Column, lease: float) -> Column:
    """A lease is alive while its age is known and at most the lease, inclusive."""
    return F.coalesce(age <= lease, F.lit(False))


def budget_exhausted(consumed: Column, limit: Column) -> Column:
    """One more would pass the limit; missing counters are 0, a null limit is unlimited."""
    return F.coalesce(F.coalesce(consumed, F.lit(0)) + 1 > limit, F.lit(False))


def attempt_budget_failure(attempts: Column, total: Column, most: Column, most_total: Column) -> Column:
    """Why the counted attempt is over budget: per activation first, then in total; null if it isn't."""
    return F.when(attempts > most, "maximum_attempts_per_activation exceeded").when(total > most_total, "maximum_total_attempts exceeded")


def retry_budget_available(attempts: Column, total: Column, most: Column, most_total: Column) -> Column:
    """Missing attempts count 1, a missing total counts the attempts; a limit reached is no budget."""
    made = F.coalesce(attempts, F.lit(1))
    return ~(F.coalesce(made >= most, F.lit(False)) | F.coalesce(F.coalesce(total, made) >= most_total, F.lit(False)))


def aged(at: Column, now: Column, days: float | None) -> Column:
    """At or before the retention cutoff; unset retention keeps everything."""
    if days is None:
        return F.lit(False)
    return at <= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))


def action_class(action: Column, kind: Column) -> Column:
    """The action where it is legal in the state, else null."""
    rules = [((action == a) & kind.isin(*kinds)) for a, kinds in ACTION_KINDS.items()]
    legal = rules[0]
    for r in rules[1:]:
        legal = legal | r
    return F.when(legal, action)


def takeover_evidence(dead: Column, persistent: Column, unsafe: Column, age: Column, lease: Column, factor: float) -> Column:
    """Why a previous attempt may be replaced, or null; the first that holds, in this order."""
    return (
        F.when(dead, "writer_process_dead")
        .when(persistent & unsafe, "unsafe_persistent_takeover")
        .when(persistent, F.lit(None))
        .when(unsafe, "unsafe_isolated_takeover")
        .when(age.isNull(), "manager_record_absent")
        .when(age >= lease * factor, "lease_grace_expired")
    )


def resolve_selectors(selectors: DataFrame, jobs: DataFrame, shown: int = 5) -> DataFrame:
    """Per selector text: its job by exact id or key, else by unique key prefix, else why not.

    status is found, ambiguous (with the ``shown`` least candidates) or not found.  Keys meet
    selectors by their prefixes of the selectors' lengths, so all joins are equalities, and
    a selector never holds more than ``shown`` keys in one place.  A selector is a short
    text: the distinct lengths of the selectors bound the prefixes of a key.
    """
    keyed = jobs.select(F.col("job_id").cast("string").alias("id"), "job_key")
    by_id = selectors.join(keyed.withColumnRenamed("id", "selector"), "selector")
    by_key = selectors.join(keyed.select(F.col("job_key").alias("selector"), "job_key"), "selector")
    exact = by_id.select("selector", "job_key").unionByName(by_key).groupBy("selector").agg(F.min("job_key").alias("exact"))
    lengths = sorted(r[0] for r in selectors.select(F.length("selector")).distinct().collect())
    cut = F.array(*[F.when(F.length("job_key") >= n, F.substring("job_key", 1, n)) for n in lengths])
    starts = keyed.select("job_key", F.explode(F.array_compact(cut)).alias("selector")).join(selectors.distinct(), "selector", "left_semi")
    counts = starts.groupBy("selector").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("selector").orderBy("job_key"))
    least = starts.withColumn("_r", place).where(F.col("_r") <= shown).groupBy("selector").agg(F.array_sort(F.collect_list("job_key")).alias("candidates"))
    both = selectors.join(exact, "selector", "left").join(counts, "selector", "left").join(least, "selector", "left")
    status = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "found").when(F.col("n") > 1, "ambiguous").otherwise("not found")
    return both.select(
        "selector",
        status.alias("status"),
        F.coalesce("exact", F.when(F.col("n") == 1, F.get("candidates", F.lit(0)))).alias("job_key"),
        F.when(status == "ambiguous", F.array_join("candidates", ",")).alias("candidates"),
    )
