"""Every operator as a query over the test tables, with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import cte, table, view
from .functions import lattice, scalars
from .operators import census, dag, dataflow, folds, joins, predicates, textlog
from .plans import collect, reports, states
from .schemas import QUIESCENT_KINDS, RETENTION_CATEGORIES
from .sources.scratch import scratch_folder
from .streaming import decisions, state_machine

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
NOW = "1998-12-01 00:00:00"
#: Days that each category is kept; None keeps it for good.
RETENTION = {
    "attempt_control": 365.0, "transaction_trash": 30.0, "retired_bundles": 90.0, "transfer_records": 0.0, "tmp_entries": 1.0,
    "retired_requests": None, "journal_segments": 1000.0, "manager_directories": 700.0, "placement_directories": 2000.0,
}


def query(*sources: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of derived relations; ``sql`` follows their common table expressions."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[(view if s.startswith("fx_") else table)(spark, sf_dir, s) for s in sources])

        _QUERIES[f.__name__] = run
        if sql:
            named = [s for s in sources if s.startswith("fx_")]
            _ORACLE[f.__name__] = (cte(*named) + "\n" if named else "") + sql.strip()
        return f

    return register


# --- jobs: lists, selection, eligibility -------------------------------------------------


@query("fx_job", sql="SELECT kind, count(*) AS n FROM fx_job GROUP BY kind")
def status_counts(jobs):
    return census.status_counts(jobs)


@query(
    "fx_job", "fx_frame",
    sql="""SELECT j.job_id, j.job_key, j.placement, j.kind, j.priority, j.pool, f.kind AS frame_kind, f.generation AS frame_generation
FROM fx_job j LEFT JOIN (SELECT * FROM fx_frame QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1) f ON f.job_id = j.job_id
WHERE j.placement = 'r1/n1' OR starts_with(j.placement, 'r1/n1/') ORDER BY j.placement, j.job_key""",
)
def list_jobs_prefix(jobs, frames):
    listed = predicates.list_jobs(jobs, frames, placement="r1/n1")
    return listed.select("job_id", "job_key", "placement", "kind", "priority", "pool", "frame_kind", "frame_generation")


@query(
    "fx_job",
    sql="""SELECT s.selector, CASE WHEN e.k IS NOT NULL OR p.n = 1 THEN 'found' WHEN p.n > 1 THEN 'ambiguous' ELSE 'not found' END AS status,
coalesce(e.k, CASE WHEN p.n = 1 THEN p.ks[1] END) AS job_key,
CASE WHEN e.k IS NULL AND p.n > 1 THEN array_to_string(p.ks[1:5], ',') END AS candidates
FROM (VALUES ('7'), ('o--77'), ('o--12'), ('o--1234'), ('o--99999999'), ('x')) s(selector)
LEFT JOIN LATERAL (SELECT min(job_key) AS k FROM fx_job j WHERE j.job_key = s.selector OR CAST(j.job_id AS VARCHAR) = s.selector) e ON true
LEFT JOIN LATERAL (SELECT count(*) AS n, list(job_key ORDER BY job_key) AS ks FROM fx_job j WHERE starts_with(j.job_key, s.selector)) p ON true""",
)
def resolve_prefix(jobs):
    texts = [("7",), ("o--77",), ("o--12",), ("o--1234",), ("o--99999999",), ("x",)]
    return predicates.resolve_selectors(jobs.sparkSession.createDataFrame(texts, "selector string"), jobs)


ELIGIBLE = """SELECT job_id, job_key, priority, placement FROM fx_job
WHERE kind = 'ready' AND executor IN ('path') AND pool IN ('BUILDING', 'MACHINERY') AND capabilities IN ('', 'mpi')"""


def _eligible(jobs):
    return predicates.eligible_ready(jobs, ["path"], ["BUILDING", "MACHINERY"], ["mpi"]).select("job_id", "job_key", "priority", "placement")


@query("fx_job", sql=ELIGIBLE)
def eligible_ready(jobs):
    return _eligible(jobs)


@query("fx_job", sql=f"SELECT *, row_number() OVER (ORDER BY priority, placement, job_key) AS slot FROM ({ELIGIBLE}) QUALIFY slot <= 50")
def claim_topk(jobs):
    return predicates.claim_order(_eligible(jobs), 50)


AREA = "array_to_string(string_split(placement, '/')[1:2], '/')"
#: Requirement classes against all managers, by brute force.
REFUSAL = f""", c AS (SELECT executor, pool, capabilities, {AREA} AS area, count(*) AS n_jobs FROM fx_job WHERE kind = 'ready' GROUP BY ALL),
p AS (SELECT c.*, m.manager_id,
  (NOT list_contains(string_split(m.executors, ','), c.executor))::INT + (NOT m.accept_any_pool AND NOT list_contains(string_split(m.pools, ','), c.pool))::INT
  + (len(list_filter(string_split(c.capabilities, ','), lambda v: v <> '' AND NOT list_contains(string_split(m.capabilities, ','), v))) > 0)::INT
  + (m.placement_prefixes <> '' AND len(list_filter(string_split(m.placement_prefixes, ','), lambda x: c.area = x OR starts_with(c.area, x || '/'))) = 0)::INT AS refused
FROM c, fx_manager m)
"""
#: Reasons of one pair of job j and manager m.
REASONS = """list_filter([
  CASE WHEN j.owner_uid <> m.uid THEN 'owner ' || CAST(j.owner_uid AS VARCHAR) END,
  CASE WHEN NOT list_contains(string_split(m.executors, ','), j.executor) THEN 'executor ' || j.executor END,
  CASE WHEN NOT m.accept_any_pool AND NOT list_contains(string_split(m.pools, ','), j.pool) THEN 'pool ' || j.pool END,
  'capabilities ' || nullif(array_to_string(list_sort(list_filter(string_split(j.capabilities, ','), lambda v: v <> '' AND NOT list_contains(string_split(m.capabilities, ','), v))), ','), ''),
  CASE WHEN m.placement_prefixes <> '' AND len(list_filter(string_split(m.placement_prefixes, ','), lambda x: j.placement = x OR starts_with(j.placement, x || '/'))) = 0 THEN 'placement ' || j.placement END,
  CASE WHEN j.runner = 'pkg:site.a' AND m.runner_modules = '' THEN 'runner module site.a' END,
  CASE WHEN j.runner = 'installed' AND NOT m.searches THEN 'runner search path' END], lambda r: r IS NOT NULL)"""


@query(
    "fx_job", "fx_manager", "fx_child",
    sql=f""", q AS (SELECT DISTINCT parent_id AS job_id, supp AS manager_id FROM fx_child)
SELECT q.job_id, q.manager_id, array_to_string(r, '; ') AS reasons, CAST(len(r) AS BIGINT) AS n_reasons
FROM (SELECT q.*, {REASONS} AS r FROM q JOIN fx_job j USING (job_id) JOIN fx_manager m USING (manager_id)) q""",
)
def job_manager_refusals(jobs, managers, children):
    pairs = children.select(F.col("parent_id").alias("job_id"), F.col("supp").alias("manager_id")).distinct()
    refused = predicates.pair_refusals(pairs, jobs, managers)
    return refused.select("job_id", "manager_id", F.array_join("reasons", "; ").alias("reasons"), F.size("reasons").cast("long").alias("n_reasons"))


@query(
    "fx_job", "fx_manager",
    sql=REFUSAL + f""", b AS (SELECT executor, pool, capabilities, area, count(*) FILTER (WHERE refused = 0) AS n_eligible, arg_min(manager_id, (refused, manager_id)) AS manager_id FROM p GROUP BY ALL)
SELECT job_id, n_eligible, manager_id, CAST(len(r) AS BIGINT) AS n_reasons, array_to_string(r, '; ') AS reasons FROM (
SELECT j.job_id, b.n_eligible, b.manager_id, {REASONS} AS r FROM (SELECT *, {AREA} AS area FROM fx_job WHERE kind = 'ready') j
JOIN b ON j.executor = b.executor AND j.pool = b.pool AND j.capabilities = b.capabilities AND j.area = b.area JOIN fx_manager m ON m.manager_id = b.manager_id)""",
)
def closest_manager(jobs, managers):
    return predicates.closest_manager(jobs, managers)


@query("fx_manager", sql="SELECT manager_id, heartbeat_age_seconds, heartbeat_age_seconds <= 900 AS alive FROM fx_manager")
def manager_liveness(managers):
    return managers.select("manager_id", "heartbeat_age_seconds", predicates.alive(F.col("heartbeat_age_seconds"), 900).alias("alive"))


@query(
    "fx_manager",
    sql="""SELECT count(*) AS registered, count(*) FILTER (WHERE heartbeat_age_seconds <= 900) AS live,
CASE WHEN count(*) = 0 THEN 'none registered' WHEN count(*) FILTER (WHERE heartbeat_age_seconds <= 900) = 0 THEN 'none live' END AS notice FROM fx_manager""",
)
def manager_availability(managers):
    live = F.count_if(predicates.alive(F.col("heartbeat_age_seconds"), 900))
    notice = F.when(F.count("*") == 0, "none registered").when(live == 0, "none live")
    return managers.agg(F.count("*").alias("registered"), live.alias("live"), notice.alias("notice"))


@query(
    "fx_job",
    sql="""SELECT label_kind, label, count(*) AS n FROM (SELECT CASE
  WHEN kind IN ('succeeded', 'failed', 'waiting', 'paused') THEN ['settled', kind]
  WHEN kind = 'submitted' AND NOT readable THEN ['actionable', kind]
  WHEN kind IN ('ready', 'committing', 'cancelling') AND NOT readable THEN ['unreadable', kind]
  WHEN kind IN ('submitted', 'ready') AND executor <> 'path' THEN ['executor', executor]
  WHEN kind = 'submitted' THEN ['actionable', kind]
  WHEN kind = 'ready' AND pool NOT IN ('BUILDING') THEN ['pool', pool]
  WHEN kind = 'ready' AND capabilities = 'gpu,mpi' THEN ['capability', 'gpu']
  WHEN kind = 'ready' THEN ['actionable', kind]
  WHEN kind IN ('committing', 'cancelling') AND executor = 'path' THEN ['actionable', kind] END AS c, c[1] AS label_kind, c[2] AS label FROM fx_job)
WHERE c IS NOT NULL GROUP BY ALL""",
)
def work_census(jobs):
    return census.work_census(jobs, ["path"], ["BUILDING"], ["mpi"])


@query(
    "fx_job",
    sql="""SELECT job_id, attempts, max_attempts, total_attempts, max_total,
coalesce(attempts + 1 > max_attempts, false) OR coalesce(total_attempts + 1 > max_total, false) AS exhausted,
CASE WHEN attempts > max_attempts THEN 'maximum_attempts_per_activation exceeded' WHEN total_attempts > max_total THEN 'maximum_total_attempts exceeded' END AS failure FROM fx_job""",
)
def budget_status(jobs):
    limits = [F.col(c) for c in ("attempts", "total_attempts", "max_attempts", "max_total")]
    used = predicates.budget_exhausted(limits[0], limits[2]) | predicates.budget_exhausted(limits[1], limits[3])
    return jobs.select("job_id", "attempts", "max_attempts", "total_attempts", "max_total", used.alias("exhausted"), predicates.attempt_budget_failure(*limits).alias("failure"))


@query(
    "fx_job",
    sql="""SELECT job_id, NOT (coalesce(attempts >= max_attempts, false) OR coalesce(total_attempts >= max_total, false)) AS may_retry,
CASE job_id % 6 WHEN 0 THEN 'succeeded' WHEN 3 THEN 'waiting' WHEN 4 THEN 'paused' WHEN 5 THEN CASE WHEN attempts + 1 > 3 THEN 'failed' ELSE 'ready' END
  WHEN 1 THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'ready' END
  WHEN 2 THEN CASE WHEN job_id % 4 <> 0 OR coalesce(attempts >= max_attempts, false) OR coalesce(total_attempts >= max_total, false) THEN 'failed' ELSE 'ready' END END AS next_kind FROM fx_job""",
)
def retry_decision(jobs):
    limits = [F.col(c) for c in ("attempts", "total_attempts", "max_attempts", "max_total")]
    outcome = F.element_at(F.array(*map(F.lit, ("succeed", "retry", "fail", "wait", "pause", "advance"))), (F.col("job_id") % 6 + 1).cast("int"))
    next_kind = decisions.commit_decision(outcome, F.col("job_id") % 4 == 0, *limits, F.col("attempts"), F.lit(3))
    return jobs.select("job_id", predicates.retry_budget_available(*limits).alias("may_retry"), next_kind.alias("next_kind"))


@query(
    "fx_job",
    sql="""SELECT a.action, j.kind, count(*) AS n, CASE
  WHEN a.action = 'cancel' AND j.kind NOT IN ('succeeded', 'failed', 'cancelled') THEN 'cancel'
  WHEN a.action = 'set_priority' AND j.kind IN ('submitted', 'ready', 'waiting', 'paused', 'failed') THEN 'set_priority'
  WHEN a.action = 'pause' AND j.kind IN ('submitted', 'ready', 'waiting', 'claimed', 'running', 'committing', 'paused') THEN 'pause'
  WHEN a.action IN ('continue', 'override_step') AND j.kind IN ('failed', 'paused') THEN a.action END AS legal
FROM fx_job j, (VALUES ('cancel'), ('set_priority'), ('pause'), ('continue'), ('override_step')) a(action) GROUP BY a.action, j.kind""",
)
def action_classes(jobs):
    actions = F.explode(F.array(*map(F.lit, ("cancel", "set_priority", "pause", "continue", "override_step"))))
    counted = jobs.groupBy("kind").agg(F.count("*").alias("n")).withColumn("action", actions)
    return counted.select("action", "kind", "n", predicates.action_class(F.col("action"), F.col("kind")).alias("legal"))


@query(
    "fx_job",
    sql="""SELECT r.request_id, r.job_id, r.action, CASE
  WHEN r.action = 'pause' AND j.kind NOT IN ('submitted', 'ready', 'waiting', 'claimed', 'running', 'committing', 'paused') THEN 'invalid'
  WHEN r.action = 'continue' AND j.kind NOT IN ('failed', 'paused') THEN 'invalid'
  WHEN j.job_id IS NULL THEN 'invalid' WHEN r.expected <> j.job_id % 4 THEN 'stale' ELSE 'apply' END AS fate
FROM (SELECT job_id * 10 AS request_id, job_id + 5 AS job_id, CASE job_id % 2 WHEN 0 THEN 'pause' ELSE 'continue' END AS action, job_id % 4 AS expected FROM fx_job) r
LEFT JOIN fx_job j ON r.job_id = j.job_id""",
)
def sort_requests(jobs):
    action = F.when(F.col("job_id") % 2 == 0, "pause").otherwise("continue")
    requests = jobs.select((F.col("job_id") * 10).alias("request_id"), (F.col("job_id") + 5).alias("job_id"), action.alias("action"), (F.col("job_id") % 4).alias("expected_generation"))
    sorted_ = decisions.sort_requests(requests, jobs.withColumn("generation", F.col("job_id") % 4))
    return sorted_.select("request_id", "job_id", "action", "fate")


@query(
    "fx_job", "fx_manager",
    sql="""SELECT j.job_id, CASE WHEN j.job_id % 13 = 0 THEN 'writer_process_dead' WHEN j.job_id % 2 = 0 AND j.job_id % 3 = 0 THEN 'unsafe_persistent_takeover'
  WHEN j.job_id % 2 = 0 THEN NULL WHEN j.job_id % 3 = 0 THEN 'unsafe_isolated_takeover' WHEN m.manager_id IS NULL THEN 'manager_record_absent'
  WHEN m.heartbeat_age_seconds >= 600 THEN 'lease_grace_expired' END AS evidence
FROM fx_job j LEFT JOIN fx_manager m ON m.manager_id = j.job_id % 1500""",
)
def takeover_evidence(jobs, managers):
    owned = jobs.withColumn("manager_id", F.col("job_id") % 1500).join(managers.select("manager_id", "heartbeat_age_seconds"), "manager_id", "left")
    job = F.col("job_id")
    evidence = predicates.takeover_evidence(job % 13 == 0, job % 2 == 0, job % 3 == 0, F.col("heartbeat_age_seconds"), F.lit(300.0), 2.0)
    return owned.select("job_id", evidence.alias("evidence"))


@query(
    "fx_job", "fx_manager",
    sql="SELECT j.job_id, j.job_id % 1500 AS manager_id FROM fx_job j WHERE kind = 'running' AND j.job_id % 1500 NOT IN (SELECT manager_id FROM fx_manager WHERE heartbeat_age_seconds <= 900)",
)
def abandoned_claims(jobs, managers):
    claimed = jobs.where("kind = 'running'").select("job_id", (F.col("job_id") % 1500).alias("manager_id"))
    return decisions.abandoned(claimed, managers, 900).select("job_id", "manager_id")


# --- child sets --------------------------------------------------------------------------

VERDICT = """, cc AS (SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE kind = 'succeeded') AS good,
  count(*) FILTER (WHERE kind IN ('succeeded', 'failed', 'cancelled')) AS done FROM fx_child GROUP BY parent_id),
v AS (SELECT j.parent_id, j.cond, j.has_on_impossible, cc.n, CASE
  WHEN (cond = 'all_succeeded' AND good = n) OR (cond = 'all_terminal' AND done = n) OR (cond = 'any_succeeded' AND good > 0)
    OR (cond = 'any_terminal' AND done > 0) OR (cond = 'at_least' AND good >= k) THEN 'satisfied'
  WHEN (cond = 'all_succeeded' AND done > good) OR (cond = 'any_succeeded' AND done = n AND good = 0) OR (cond = 'at_least' AND good + n - done < k) THEN 'impossible'
  ELSE 'blocked' END AS verdict FROM fx_join j JOIN cc USING (parent_id))
"""


@query("fx_join", "fx_child", sql=VERDICT + "SELECT parent_id, cond, n, verdict FROM v")
def join_verdict(waits, children):
    return joins.join_verdicts(waits, children).select("parent_id", "cond", "n", "verdict")


@query(
    "fx_join", "fx_child",
    sql=VERDICT + """SELECT parent_id, verdict, CASE verdict WHEN 'satisfied' THEN 'advance'
  WHEN 'impossible' THEN CASE WHEN has_on_impossible THEN 'advance_on_impossible' ELSE 'fail:dependency_failure' END ELSE 'wait' END AS outcome FROM v""",
)
def join_outcome(waits, children):
    return joins.join_outcomes(joins.join_verdicts(waits, children)).select("parent_id", "verdict", "outcome")


@query(
    "fx_child",
    sql=""", p AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY line, child_id, supp, shipped, price) AS position FROM fx_child)
SELECT parent_id, count(*) AS n, min(position) FILTER (WHERE NOT resolved) AS first_missing, coalesce(min(position) FILTER (WHERE NOT resolved) - 1, count(*)) AS observed FROM p GROUP BY parent_id""",
)
def join_first_unresolved(children):
    return joins.first_unresolved(children, ["line", "child_id", "supp", "shipped", "price"])


@query(
    "fx_frame",
    sql=""", s AS (SELECT job_id, concat('l', cast(event_id % 4 AS VARCHAR)) AS label, event_id % 9 AS child, CASE WHEN event_id % 3 > 0 THEN kind END AS kind, generation AS position FROM fx_frame),
l AS (SELECT *, last_value(child) OVER (PARTITION BY job_id, label ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest FROM s),
r AS (SELECT *, max(CASE WHEN child <> latest THEN position ELSE 0 END) OVER (PARTITION BY job_id, label) AS since FROM l)
SELECT job_id, label, max(latest) AS child, arg_max(kind, position) FILTER (WHERE kind IS NOT NULL AND position > since) AS kind, min(position) AS first_position FROM r GROUP BY job_id, label""",
)
def children_by_label(frames):
    spawns = frames.select(
        "job_id",
        F.concat(F.lit("l"), (F.col("event_id") % 4).cast("string")).alias("label"),
        (F.col("event_id") % 9).alias("child"),
        F.when(F.col("event_id") % 3 > 0, F.col("kind")).alias("kind"),
        F.col("generation").alias("position"),
    )
    return joins.children_by_label(spawns)


# --- histories ---------------------------------------------------------------------------


@query(
    "fx_frame",
    sql="""SELECT job_id, generation, coalesce(last_value(CASE WHEN NOT is_error THEN kind END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'submitted') AS from_kind,
CASE WHEN NOT is_error THEN kind END AS to_kind, is_error FROM fx_frame""",
)
def transition_log(frames):
    return folds.transition_log(frames)


ISLANDS = """, b AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(activation_id) OVER w IS DISTINCT FROM activation_id THEN 1 ELSE 0 END AS s
  FROM fx_frame WHERE NOT is_error WINDOW w AS (PARTITION BY job_id ORDER BY generation)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY job_id ORDER BY generation ROWS UNBOUNDED PRECEDING) AS BIGINT) AS activation_no FROM b)
"""


@query(
    "fx_frame",
    sql=ISLANDS + """SELECT job_id, activation_no, arg_min(activation_id, generation) AS activation_id, min(generation) AS first_generation, max(generation) AS last_generation,
count(*) AS n_frames, arg_min(created_at, generation) AS started_at, arg_min(kind, generation) AS first_kind, arg_min(step, generation) AS step, arg_min_null(reason, generation) AS reason FROM i GROUP BY job_id, activation_no""",
)
def timeline_activations(frames):
    return folds.timeline_activations(frames)


ATTEMPTS = ISLANDS + """, a AS (SELECT *, CAST(sum(CASE WHEN kind = 'claimed' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, activation_no ORDER BY generation ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt_no FROM i),
o AS (SELECT *, first_value(attempt_id) OVER (PARTITION BY job_id, activation_no, attempt_no ORDER BY generation) AS own FROM a WHERE attempt_no > 0),
t AS (SELECT job_id, activation_no, attempt_no, arg_min(attempt_id, generation) AS attempt_id, min(generation) AS claim_generation,
  arg_max_null(coalesce(started_at, created_at), generation) FILTER (WHERE kind = 'running') AS started_at,
  arg_min(created_at, generation) FILTER (WHERE kind NOT IN ('claimed', 'running')) AS finished_at,
  arg_min(failure_code, generation) FILTER (WHERE kind NOT IN ('claimed', 'running') AND failure_code IS NOT NULL) AS failure_code,
  arg_max_null(outcome_action, generation) FILTER (WHERE kind = 'committing') AS outcome_action, count(*) AS n_frames
  FROM o WHERE attempt_id IS NOT DISTINCT FROM own GROUP BY job_id, activation_no, attempt_no)
"""


@query("fx_frame", sql=ATTEMPTS + "SELECT * FROM t")
def timeline_attempts(frames):
    return folds.timeline_attempts(frames)


@query(
    "fx_record",
    sql="""SELECT job_id, count(DISTINCT attempt_id) AS n_attempts, count(DISTINCT activation_id) AS n_activations, arg_max(step, generation) FILTER (WHERE step IS NOT NULL) AS last_step,
count(*) FILTER (WHERE unclean_restart) AS n_unclean, arg_max(failure_code, generation) FILTER (WHERE failure_code IS NOT NULL) AS last_failure,
count(*) FILTER (WHERE kind = 'failed') AS n_failed, max(generation) AS generation FROM (SELECT * REPLACE (CASE WHEN generation % 3 > 0 THEN step END AS step) FROM fx_record) GROUP BY job_id""",
)
def attempt_history(frames):
    return census.attempt_history(frames.withColumn("step", F.when(F.col("generation") % 3 > 0, F.col("step"))))


@query(
    "fx_job",
    sql="SELECT job_id, greatest(attempts, total_attempts) AS tries FROM fx_job WHERE greatest(attempts, total_attempts) > 3 AND max_attempts IS NULL AND max_total IS NULL",
)
def flapping(jobs):
    return census.flapping(jobs, limit=3).select("job_id", "tries")


@query(
    "fx_frame",
    sql="""SELECT job_id, generation, kind, row_number() OVER (PARTITION BY job_id ORDER BY generation) AS position
FROM (SELECT * FROM fx_frame QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) <= 5)""",
)
def latest_frames(frames):
    return folds.latest_frames(frames, 5).select("job_id", "generation", "kind", "position")


@query(
    "fx_frame",
    sql=ISLANDS + "SELECT job_id, generation, last_value(failure_code IGNORE NULLS) OVER (PARTITION BY job_id, activation_no ORDER BY generation ROWS UNBOUNDED PRECEDING) AS failure_code FROM i",
)
def carried_members(frames):
    return folds.carried_members(frames, "failure_code").select("job_id", "generation", "failure_code")


MARKED = "SELECT job_id, CAST(max(generation) AS BIGINT) AS marker_generation FROM fx_frame GROUP BY job_id"


@query(
    "fx_frame",
    sql=f"""SELECT m.job_id, m.marker_generation, f.generation, f.kind, f.event_id FROM ({MARKED}) m LEFT JOIN LATERAL
(SELECT * FROM fx_frame f WHERE f.job_id = m.job_id AND NOT f.is_error AND f.generation < m.marker_generation ORDER BY f.generation DESC, f.event_id DESC LIMIT 1) f ON true""",
)
def last_good_frame(frames):
    markers = frames.groupBy("job_id").agg(F.max("generation").alias("marker_generation"))
    return joins.last_good_frame(markers, frames)


@query(
    "fx_marker", "fx_record", "fx_manager",
    sql="""SELECT job_id, generation, manager_id FROM (SELECT f.job_id, f.generation, m.manager_id FROM fx_record f JOIN fx_manager m ON m.manager_id = f.manager_id
WHERE NOT f.is_error AND m.heartbeat_age_seconds <= coalesce(f.lease_seconds, 300) AND f.job_id IN (SELECT job_id FROM fx_marker WHERE kind IN ('claimed', 'running', 'committing', 'cancelling')))
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1""",
)
def live_owner(markers, records, managers):
    return joins.live_owner(markers, records, managers, 300)


INTEGRITY = """, g AS (SELECT m.job_id, m.generation, m.kind, CASE
  WHEN m.record_ref = 'init' THEN CASE WHEN m.kind = 'submitted' AND m.generation = 0 THEN 'ok' ELSE 'mismatch:init' END
  WHEN r.record_ref IS NULL THEN 'missing' WHEN r.is_error THEN 'unreadable' WHEN m.format <> r.format THEN 'mismatch:format'
  WHEN m.format_version <> r.format_version THEN 'mismatch:format_version' WHEN m.workspace_id <> r.workspace_id THEN 'mismatch:workspace_id'
  WHEN m.job_id <> r.job_id THEN 'mismatch:job_id' WHEN m.job_key <> r.job_key THEN 'mismatch:job_key' WHEN m.kind <> r.kind THEN 'mismatch:kind'
  WHEN m.generation <> r.generation THEN 'mismatch:generation' ELSE 'ok' END AS finding FROM fx_marker m LEFT JOIN fx_record r ON m.record_ref = r.record_ref)
"""


@query("fx_marker", "fx_record", sql=INTEGRITY + "SELECT * FROM g")
def fsck_identity(markers, records):
    return reports.integrity(markers, records)


FINDINGS = ("ok", "missing", "unreadable", "mismatch:init", *(f"mismatch:{c}" for c in reports.IDENTITY))


@query(
    "fx_marker", "fx_record",
    sql=INTEGRITY + f"SELECT a.finding, count(g.finding) AS n FROM (SELECT unnest({list(FINDINGS)}) AS finding) a LEFT JOIN g USING (finding) GROUP BY a.finding",
)
def fsck_report(markers, records):
    counted = reports.integrity(markers, records).groupBy("finding").agg(F.count("*").alias("n"))
    names = markers.sparkSession.createDataFrame([(n,) for n in FINDINGS], "finding string")
    return names.join(counted, "finding", "left").select("finding", F.coalesce("n", F.lit(0)).alias("n"))


@query("fx_frame", sql="SELECT job_id, kind, count(*) AS n FROM fx_frame GROUP BY job_id, kind HAVING count(*) > 1")
def duplicate_kinds(frames):
    return census.duplicates(frames, "job_id", "kind")


@query(
    "fx_frame",
    sql=""", d AS (SELECT DISTINCT failure_code, job_id FROM fx_frame WHERE failure_code IS NOT NULL)
SELECT failure_code, count(*) AS n_jobs, array_to_string(list(job_id ORDER BY job_id)[1:10], ',') AS first_jobs FROM d GROUP BY failure_code""",
)
def failure_summary(frames):
    return census.failure_summary(frames)


@query(
    "fx_frame",
    sql="""SELECT job_id, generation, position, greatest(n - 6, 0) AS dropped FROM (SELECT job_id, generation, row_number() OVER (PARTITION BY job_id ORDER BY generation) AS position, count(*) OVER (PARTITION BY job_id) AS n FROM fx_frame)
WHERE position <= 3 OR position > n - 3""",
)
def head_and_tail(frames):
    return census.head_and_tail(frames.select("job_id", "generation"), ["job_id"], "generation", 6)


@query(
    "fx_frame",
    sql="SELECT job_id, kind, failure_code, min(generation) AS generation FROM fx_frame GROUP BY job_id, kind, failure_code",
)
def keep_first(frames):
    return folds.keep_first(frames.select("job_id", "kind", "failure_code", "generation"), ["job_id", "kind", "failure_code"], "generation")


@query(
    "fx_frame",
    sql="""SELECT job_id, generation, turn, row_number() OVER (ORDER BY turn, job_id <= 70, job_id) AS served
FROM (SELECT job_id, generation, row_number() OVER (PARTITION BY job_id ORDER BY generation) AS turn FROM fx_frame)""",
)
def round_robin(frames):
    return folds.with_places(folds.round_robin(frames.select("job_id", "generation"), "job_id", "generation", 70), "job_id", 70)


@query(
    "fx_frame",
    sql="""SELECT job_id, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), generation) AS k, count(*) AS n FROM fx_frame GROUP BY job_id""",
)
def last_member(frames):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return frames.groupBy("job_id").agg(F.max_by(k, "generation").alias("k"), F.count("*").alias("n"))


# --- retention ---------------------------------------------------------------------------

GC = f"""SELECT job_id, category, mtime, size_bytes, name FROM fx_file JOIN (VALUES ('attempt_control', 365), ('transaction_trash', 30), ('retired_bundles', 90), ('transfer_records', 0), ('tmp_entries', 1), ('journal_segments', 1000), ('manager_directories', 700),
  ('placement_directories', 2000)) k(category, days) USING (category) WHERE mtime <= TIMESTAMP '{NOW}' - to_days(CAST(days AS INT))"""


@query("fx_file", sql=GC)
def gc_candidates(files):
    return census.gc_candidates(files, NOW, RETENTION).select("job_id", "category", "mtime", "size_bytes", "name")


@query(
    "fx_file",
    sql=f"""SELECT CAST(c.position AS INT) AS position, c.category, count(g.category) AS candidates, coalesce(CAST(sum(CAST(g.size_bytes AS DECIMAL(20, 2))) AS DOUBLE), 0) AS bytes
FROM (SELECT unnest({list(RETENTION_CATEGORIES)}) AS category, unnest(range(0, {len(RETENTION_CATEGORIES)})) AS position) c LEFT JOIN ({GC}) g USING (category) GROUP BY ALL""",
)
def gc_report(files):
    sized = census.gc_candidates(files, NOW, RETENTION).withColumn("size_bytes", F.col("size_bytes").cast("decimal(20,2)"))
    return census.category_report(files.sparkSession, sized, RETENTION_CATEGORIES)


@query(
    "fx_file",
    sql="SELECT job_id, mtime, name, row_number() OVER (PARTITION BY job_id ORDER BY mtime DESC, name DESC) AS age_rank FROM fx_file QUALIFY age_rank > 1",
)
def newest_per_job(files):
    return census.all_but_newest(files).select("job_id", "mtime", "name", "age_rank")


@query(
    "fx_file",
    sql="""SELECT job_id, sha256(string_agg(e, chr(10) ORDER BY e)) AS digest, count(*) AS n_files
FROM (SELECT job_id, name || '|' || category || '|' || CAST(CAST(size_bytes AS DECIMAL(20, 2)) AS VARCHAR) AS e FROM fx_file) GROUP BY job_id""",
)
def tree_digest(files):
    return census.tree_digest(files)


# --- declarations, layers, partitions, transfers -------------------------------------------


@query(
    "fx_declaration",
    sql="SELECT job_id, declared, observed, CASE WHEN declared IS NULL THEN 'observed' WHEN observed IS NULL THEN 'declared' ELSE 'both' END AS found FROM fx_declaration WHERE declared IS NOT NULL OR observed IS NOT NULL",
)
def declarations_merge(merged):
    declared = merged.where("declared IS NOT NULL").select("job_id", "declared")
    observed = merged.where("observed IS NOT NULL").select("job_id", "observed")
    return joins.declarations_merge(declared, observed, "job_id")


@query(
    "fx_job",
    sql="""SELECT job_id, coalesce(CASE WHEN job_id % 7 = 0 THEN 'o' END, CASE WHEN job_id % 5 = 0 THEN pool END, CASE WHEN job_id % 3 = 0 THEN 'w' END, CASE WHEN job_id % 2 = 0 THEN 'd' END) AS value,
CASE WHEN job_id % 7 = 0 THEN 'override' WHEN job_id % 5 = 0 THEN 'environment' WHEN job_id % 3 = 0 THEN 'workspace' WHEN job_id % 2 = 0 THEN 'default' ELSE 'unresolved' END AS source FROM fx_job""",
)
def env_layering(jobs):
    each = lambda n, c: F.when(F.col("job_id") % n == 0, c)
    value, source = joins.layered([("override", each(7, F.lit("o"))), ("environment", each(5, F.col("pool"))), ("workspace", each(3, F.lit("w"))), ("default", each(2, F.lit("d")))])
    return jobs.select("job_id", value.alias("value"), source.alias("source"))


@query(
    "fx_job",
    sql="""SELECT coalesce(b.label, o.label) AS label, coalesce(o.value, b.value) AS value, CASE WHEN o.label IS NULL THEN 'base' WHEN b.label IS NULL THEN 'added' ELSE 'replaced' END AS origin,
coalesce(b.position, 1099511627776 + o.position) AS "order" FROM (SELECT job_key AS label, job_id AS position, pool AS value FROM fx_job WHERE job_id % 3 > 0) b
FULL JOIN (SELECT job_key AS label, job_id AS position, executor AS value FROM fx_job WHERE job_id % 2 = 0) o ON b.label = o.label""",
)
def overlay_edges(jobs):
    rows = jobs.select(F.col("job_key").alias("label"), F.col("job_id").alias("position"), "pool", "executor")
    base = rows.where("position % 3 > 0").withColumn("value", F.col("pool"))
    owned = rows.where("position % 2 = 0").withColumn("value", F.col("executor"))
    return joins.overlay_edges(base, owned)


@query("customer", sql="SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 3 AS INT) AS part3, CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 1 AS INT) AS part1 FROM customer")
def campaign_partition(customers):
    return customers.select("c_custkey", scalars.partition_of(F.col("c_name"), 3).alias("part3"), scalars.partition_of(F.col("c_name"), 1).alias("part1"))


@query(
    "fx_job",
    sql="""SELECT job_id, kind, CASE ('0x' || substr(sha256(job_key), 1, 16))::UBIGINT % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'north' ELSE 'south' END AS partition FROM fx_job WHERE kind = 'succeeded'""",
)
def campaign_union(jobs):
    at = jobs.where("kind = 'succeeded'").withColumn("p", scalars.partition_of(F.col("job_key"), 3))
    return collect.campaign({n: at.where(F.col("p") == i).select("job_id", "kind") for i, n in enumerate(("east", "north", "south"))})


def _waiting(jobs, children):
    return children.join(jobs.where("kind = 'waiting'").select(F.col("job_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("job_id"))


TRANSFER = """, w AS (SELECT DISTINCT child_id AS job_id FROM fx_child WHERE parent_id IN (SELECT job_id FROM fx_job WHERE kind = 'waiting')),
s AS (SELECT job_id FROM fx_job WHERE job_id % 50 = 0)
"""


@query(
    "fx_job", "fx_child",
    sql=TRANSFER + """SELECT job_id, job_key, placement, 'sealed' AS origin FROM fx_job WHERE job_id IN (SELECT job_id FROM s)
UNION ALL SELECT job_id, job_key, placement, 'live' FROM fx_job WHERE kind IN ('succeeded', 'failed', 'waiting') AND kind <> 'waiting' AND job_id NOT IN (SELECT job_id FROM s) AND job_id NOT IN (SELECT job_id FROM w)""",
)
def transfer_selection(jobs, children):
    return joins.transfer_selection(jobs, _waiting(jobs, children), jobs.where("job_id % 50 = 0").select("job_id"), ["succeeded", "failed", "waiting"])


@query(
    "fx_job", "fx_child",
    sql=TRANSFER + """SELECT r.job_id, CASE WHEN j.kind IS NULL THEN 'not found' WHEN j.kind NOT IN ('submitted', 'ready', 'waiting', 'paused', 'failed', 'succeeded', 'cancelled') THEN 'not quiescent'
  WHEN j.kind NOT IN ('succeeded', 'failed', 'waiting') THEN 'filtered by state' WHEN NOT (j.placement = 'r1' OR starts_with(j.placement, 'r1/')) THEN 'filtered by placement'
  WHEN w.job_id IS NOT NULL OR j.kind = 'waiting' THEN 'blocked by join' ELSE 'eligible' END AS reason
FROM (SELECT job_id + 100 AS job_id FROM fx_job) r LEFT JOIN fx_job j ON j.job_id = r.job_id LEFT JOIN w ON w.job_id = r.job_id""",
)
def transfer_refusal(jobs, children):
    wanted = jobs.select((F.col("job_id") + 100).alias("job_id"))
    return reports.transfer_refusal(wanted, jobs, _waiting(jobs, children), QUIESCENT_KINDS, ["succeeded", "failed", "waiting"], scalars.under_placement(F.col("placement"), "r1"))


# --- dataflow graphs -----------------------------------------------------------------------


@query(
    "fx_edge",
    sql=""", w AS (SELECT 0::BIGINT AS node, 0::BIGINT AS level UNION SELECT e.child, w.level + 1 FROM w JOIN fx_edge e ON e.parent = w.node)
SELECT node, max(level) AS level FROM w GROUP BY node""",
)
def dag_levels(edges):
    return dag.dag_levels(edges)


def _state():
    return F.when(F.col("node") % 3 == 0, "completed").when(F.col("node") % 7 == 1, "failed").otherwise("pending")


STATES = """, st AS (SELECT node, CASE WHEN node % 3 = 0 THEN 'completed' WHEN node % 7 = 1 THEN 'failed' ELSE 'pending' END AS state FROM (SELECT child AS node FROM fx_edge UNION SELECT parent FROM fx_edge))
"""


def _states(edges):
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct().withColumn("state", _state())


@query(
    "fx_edge",
    sql=STATES + "SELECT node, state FROM st WHERE state = 'pending' AND node NOT IN (SELECT e.child FROM fx_edge e JOIN st p ON p.node = e.parent WHERE p.state = 'pending')",
)
def dag_ready(edges):
    return dag.dag_ready(edges, _states(edges))


#: Rounds of the rule, one relation each; more than the test graphs are deep.
POISON = """, st AS (SELECT node, CASE WHEN node % 3 = 0 THEN 'completed' WHEN node % 7 = 1 THEN 'failed' WHEN node % 29 = 5 THEN 'stopped' ELSE 'pending' END AS state, node % 5 = 2 AS tolerant
  FROM (SELECT child AS node FROM fx_edge UNION SELECT parent FROM fx_edge)), e AS (SELECT *, (parent + child) % 6 = 0 AS barrier FROM fx_edge), r0 AS MATERIALIZED (SELECT *, 0::BIGINT AS turn FROM st)
""" + "".join(
    f""", r{k + 1} AS MATERIALIZED (SELECT r.node, CASE WHEN r.state <> 'pending' OR c.node IS NULL OR c.waits THEN r.state WHEN c.stopped THEN 'stopped' WHEN c.failed AND NOT r.tolerant THEN 'failed' ELSE r.state END AS state,
  r.tolerant, CASE WHEN r.state = 'pending' AND NOT c.waits AND (c.stopped OR (c.failed AND NOT r.tolerant)) THEN {k + 1} ELSE r.turn END AS turn
  FROM r{k} r LEFT JOIN (SELECT e.child AS node, bool_or(p.state = 'pending') AS waits, bool_or(p.state = 'stopped' AND NOT e.barrier) AS stopped, bool_or(p.state = 'failed' AND NOT e.barrier) AS failed
    FROM e JOIN r{k} p ON p.node = e.parent GROUP BY e.child) c USING (node))
"""
    for k in range(18)
)


@query("fx_edge", sql=POISON + "SELECT node, state AS fate, turn FROM r18 WHERE turn > 0")
def dag_poison(edges):
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    node = F.col("node")
    state = F.when(node % 3 == 0, "completed").when(node % 7 == 1, "failed").when(node % 29 == 5, "stopped").otherwise("pending")
    return dag.dag_poison(edges.withColumn("barrier", (F.col("parent") + F.col("child")) % 6 == 0), nodes.withColumn("state", state).withColumn("tolerant", node % 5 == 2))


ITEM_ORDER = ["line", "child_id", "supp", "shipped", "price"]


@query(
    "fx_child", "fx_join",
    sql=""", a AS (SELECT parent_id, list(child_id ORDER BY line, child_id, supp, shipped, price) AS xs, list(supp ORDER BY line, child_id, supp, shipped, price) AS ys FROM fx_child GROUP BY parent_id),
g AS (SELECT parent_id, list_transform(xs, lambda x, i: x * 10 + ys[i] % 10) AS vs FROM a)
SELECT j.parent_id, coalesce(array_to_string(g.vs, ','), '') AS gathered FROM (SELECT DISTINCT parent_id FROM fx_join) j LEFT JOIN g USING (parent_id)""",
)
def scatter_gather(children, waits):
    packed = children.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM_ORDER))).alias("s"))
    arrays = packed.select("parent_id", F.transform("s", lambda x: x["child_id"]).alias("xs"), F.transform("s", lambda x: x["supp"]).alias("ys"))
    shards = dag.scatter(arrays, ["parent_id"], ["xs", "ys"]).withColumn("v", F.col("xs") * 10 + F.col("ys") % 10)
    return dag.gather(shards, waits, "parent_id", "v").select("parent_id", F.array_join("v", ",").alias("gathered"))


@query(
    "fx_child",
    sql=""", s AS (SELECT parent_id, line, list(CASE WHEN child_id % 3 > 0 THEN child_id END ORDER BY child_id, supp, shipped, price) AS items FROM fx_child GROUP BY parent_id, line)
SELECT parent_id, array_to_string(list_filter(flatten(list(items ORDER BY line)), lambda v: v IS NOT NULL), ',') AS items FROM s GROUP BY parent_id""",
)
def link_merge(children):
    kept = F.when(F.col("child_id") % 3 > 0, F.col("child_id"))
    lists = children.groupBy("parent_id", F.col("line").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("child_id", "supp", "shipped", "price", kept.alias("v")))).alias("s"))
    sources = lists.select("parent_id", "ordinal", F.transform("s", lambda x: x["v"]).alias("items"))
    return dag.link_merge(sources, "parent_id").select("parent_id", F.array_join("items", ",").alias("items"))


@query(
    "fx_child",
    sql="""SELECT parent_id, coalesce(string_agg(CASE line % 5 WHEN 0 THEN CASE WHEN resolved THEN '-f' END WHEN 1 THEN '-p ' || child_id WHEN 2 THEN '-g' || child_id
  WHEN 3 THEN '-s ' || child_id || ',' || supp WHEN 4 THEN CASE WHEN supp % 2 = 0 THEN '-i ' || child_id || ' ' || supp END END, ' ' ORDER BY supp % 5, child_id, line, shipped, price), '') AS argv
FROM fx_child GROUP BY parent_id""",
)
def argument_order(children):
    """Flags, words apart and glued, joined items and repeated items."""
    form, child, supp = F.col("line") % 5, F.col("child_id").cast("string"), F.col("supp").cast("string")
    items = F.when(form == 0, F.array(F.col("resolved").cast("string"))).when(form < 3, F.array(child)).when((form == 3) | (F.col("supp") % 2 == 0), F.array(child, supp)).otherwise(F.array().cast("array<string>"))
    rows = children.select(
        "parent_id",
        (F.col("supp") % 5).alias("position"),
        F.struct("child_id", "line", "shipped", "price").alias("declared"),
        F.element_at(F.array(*map(F.lit, ("-f", "-p", "-g", "-s", "-i"))), (form + 1).cast("int")).alias("prefix"),
        F.when(form == 0, "boolean").when(form < 3, "string").otherwise("array").alias("kind"),
        (form != 2).alias("separate"),
        F.when(form == 3, ",").alias("item_separator"),
        items.alias("items"),
    )
    return dag.arguments(rows, "parent_id")


# --- text ----------------------------------------------------------------------------------

_LOG = "CASE doc_id % 9 WHEN 0 THEN 'ZPOTRF failed' WHEN 1 THEN 'WARNING: too few bands' WHEN 2 THEN 'BRMIX: Very Serious Problems' WHEN 3 THEN 'Fatal error: bad k-mesh' WHEN 4 THEN 'set LREAL=.FALSE.' WHEN 5 THEN 'internal ERROR in NONLR_ALLOC' ELSE '' END"
CATALOGUE = ", ".join("({}, '{}', '{}', {})".format("'" + p.replace("'", "''") + "'", c, s, str(stop).lower()) for p, c, s, stop in textlog.PATTERNS)
DIAGNOSED = f"""WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || {_LOG}, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents),
p(pattern, code, severity, stop) AS (VALUES {CATALOGUE}), f AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, code, severity, stop FROM l JOIN p ON regexp_matches(line, pattern, 'i'))
"""


def _diagnosed(documents):
    text = F.concat("text", F.lit("\n"), F.expr(_LOG))
    return textlog.diagnose_lines(textlog.text_lines(documents.select("doc_id", text.alias("text")), "doc_id")).drop("line")


@query("documents", sql=DIAGNOSED + "SELECT * FROM f")
def log_diagnosis(documents):
    return _diagnosed(documents)


@query(
    "documents",
    sql=r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents),
m AS (SELECT *, regexp_matches(line, '^[A-D]') AS starts, trim(line, e' \t\r\x0b\x0c') = '' OR regexp_matches(line, '^[M-Z]') AS blank FROM (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[M-Z]') THEN '' ELSE line END AS line FROM l)),
o AS (SELECT *, max(CASE WHEN starts THEN line_no END) OVER w AS opened, max(CASE WHEN blank AND NOT starts THEN line_no END) OVER w AS closed FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN starts THEN 'cut' ELSE line END AS line FROM o WHERE starts OR opened IS NULL OR opened < closed""",
)
def clean_log(documents):
    """Blocks that begin with A to D; lines that begin with M to Z are made blank, to end blocks."""
    lines = textlog.text_lines(documents, "doc_id")
    lines = lines.withColumn("line", F.when(F.col("line").rlike("^[M-Z]"), "").otherwise(F.col("line")))
    return textlog.without_blocks(lines, "doc_id", "^[A-D]", "cut")


@query("documents", sql=r"SELECT doc_id, nullif(regexp_extract_all(text, '([A-Za-z]+)\.', 1)[-1], '') AS last_word FROM documents")
def last_match(documents):
    return documents.select("doc_id", textlog.last_match(F.col("text"), r"([A-Za-z]+)\.").alias("last_word"))


@query(
    "documents",
    sql=DIAGNOSED + """, g AS (SELECT doc_id, bool_or(stop) AS stop FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % 11 = 0 THEN 'timeout' WHEN coalesce(g.stop, false) THEN 'diagnosed_stop' WHEN d.doc_id % 7 = 0 THEN 'process_failure'
  WHEN d.doc_id % 4 = 1 THEN 'nonconverged' WHEN d.doc_id % 4 = 2 THEN 'process_failure' ELSE 'completed' END AS classification FROM documents d LEFT JOIN g USING (doc_id)""",
)
def run_classification(documents):
    stops = _diagnosed(documents).groupBy("doc_id").agg(F.bool_or("stop").alias("stop"))
    doc = F.col("doc_id")
    codes = F.when(doc % 4 == 1, F.array(F.lit("ionic_nonconvergence"))).when(doc % 4 == 2, F.array(F.lit("incomplete_outcar"))).otherwise(F.array(F.lit("brmix")))
    joined = documents.select("doc_id").join(stops, "doc_id", "left")
    return joined.select("doc_id", textlog.run_classification(doc % 11 == 0, F.coalesce("stop", F.lit(False)), F.when(doc % 7 == 0, 1).otherwise(0), codes).alias("classification"))


@query(
    "documents",
    sql=DIAGNOSED + f""", o AS (SELECT unnest({list(textlog.REMEDY_PRECEDENCE)}) AS code, unnest(range(0, {len(textlog.REMEDY_PRECEDENCE)})) AS ordinal),
n(code, steps) AS (VALUES {", ".join(f"('{c}', {n})" for c, n in textlog.LADDER_STEPS.items())}),
b AS (SELECT doc_id, coalesce(arg_min(o.code, o.ordinal), 'unknown') AS problem FROM f LEFT JOIN o USING (code) GROUP BY doc_id)
SELECT doc_id, problem, CASE WHEN problem = 'zpotrf' THEN doc_id % 7 ELSE 0 END AS step,
  problem = 'nonlr_alloc' OR CASE WHEN problem = 'zpotrf' THEN doc_id % 7 ELSE 0 END >= coalesce(n.steps, 0) AS give_up FROM b LEFT JOIN n ON n.code = b.problem""",
)
def remedy_plan(documents):
    attempts = documents.select("doc_id", F.lit("zpotrf").alias("problem"), (F.col("doc_id") % 7).alias("step"))
    return textlog.plan_remedies(documents.sparkSession, _diagnosed(documents), attempts, "doc_id")


# --- scalars -------------------------------------------------------------------------------


def _base36(value: str) -> str:
    """Seven digits of base 36 in SQL, without leading zeros."""
    digits = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(({value}) // {36**k} % 36 AS INT) + 1, 1)" for k in range(6, -1, -1))
    return f"coalesce(nullif(ltrim({digits}, '0'), ''), '0')"


@query("orders", sql=f"SELECT o_orderkey, {_base36('o_orderkey * 7919 + 35')} AS text, o_orderkey * 7919 + 35 AS back FROM orders")
def base36_roundtrip(orders):
    text = scalars.to_base36(F.col("o_orderkey") * 7919 + 35)
    return orders.select("o_orderkey", text.alias("text"), scalars.from_base36(text).cast("long").alias("back"))


@query(
    "orders",
    sql="""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 't' || (o_orderkey % 10) || '--' ELSE '' END || 'id' || o_orderkey AS key,
CASE WHEN o_orderkey % 3 > 0 THEN 't' || CAST(o_orderkey % 10 AS VARCHAR) END AS tag, 'id' || CAST(o_orderkey AS VARCHAR) AS job_id FROM orders""",
)
def job_key_parse(orders):
    tag = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("t"), (F.col("o_orderkey") % 10).cast("string"))).otherwise("")
    key = scalars.make_job_key(tag, F.concat(F.lit("id"), F.col("o_orderkey").cast("string")))
    return orders.select("o_orderkey", key.alias("key"), scalars.parse_job_key(key).alias("k")).select("o_orderkey", "key", "k.*")


@query(
    "orders",
    sql=f"""SELECT *, 'w' || writer || '-s' || {_base36('segment')} || '-o' || {_base36('"offset"')} || '-l' || {_base36('length')} || '-h' || checksum AS ref
FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS writer, o_orderkey % 40 AS segment, o_orderkey * 131 AS "offset", o_orderkey % 4096 AS length,
substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS checksum FROM orders)""",
)
def record_ref_parse(orders):
    text, key = F.col("o_orderkey").cast("string"), F.col("o_orderkey")
    ref = scalars.encode_record_ref(F.md5(text), key % 40, key * 131, key % 4096, F.sha2(text, 256))
    return orders.select("o_orderkey", ref.alias("ref"), scalars.parse_record_ref(ref).alias("r")).select("o_orderkey", "ref", "r.*")


@query("orders", sql=f"SELECT o_orderkey, o_orderkey || '.p' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.g' || {_base36('o_orderkey')} || '.ref' AS name, CAST(o_orderkey AS BIGINT) AS generation FROM orders")
def marker_names(orders):
    key = F.col("o_orderkey")
    name = scalars.marker_basename(key.cast("string"), key % 1000, key, F.lit("ref"))
    parsed = scalars.parse_marker_basename(name)
    return orders.select("o_orderkey", name.alias("name"), parsed["generation"].cast("long").alias("generation"))


@query(
    "part",
    sql="""SELECT p_partkey, greatest(3, CAST(ceil(4.0 * (1.0 / (1 + p_size)) * 10 + 0.5) AS INT) + 1) AS kx, CAST(greatest(3, CAST(ceil(4.0 * (1.0 / 2) * 10 + 0.5) AS INT) + 1) AS INT) AS ky FROM part""",
)
def kpoint_grid(parts):
    axis = lambda i, x: F.array(*[x.cast("double") if j == i else F.lit(0.0) for j in range(3)])
    grid = lattice.kpoint_grid(axis(0, (F.col("p_size") + 1) / 10), axis(1, F.lit(0.2)), axis(2, F.lit(1.0)), 4.0, bump=1)
    return parts.select("p_partkey", F.get(grid, F.lit(0)).alias("kx"), F.get(grid, F.lit(1)).alias("ky"))


BANDS = "CASE WHEN p_partkey % 2 = 0 THEN greatest(floor(e * 0.6 + 1) + ceil(greatest(6, a) / 2), floor(e * 0.6 + 1) + ceil(abs(m) / 2), floor(e * 0.6 + 1) + 20) ELSE greatest(floor(e / 2 + 2) + ceil(greatest(6, a) / 2), ceil(e / 2) + 20) END"


@query(
    "part",
    sql=f"""SELECT p_partkey, bands + bands % 2 + ((-(bands + bands % 2)) % 4 + 4) % 4 AS bands FROM
(SELECT p_partkey, CAST({BANDS} AS BIGINT) AS bands FROM (SELECT p_partkey, p_size * 3.5 AS e, p_size AS a, p_size - 25 AS m FROM part))""",
)
def band_counts(parts):
    size = F.col("p_size")
    return parts.select("p_partkey", lattice.band_count(size * 3.5, size, F.col("p_partkey") % 2 * -1 + 2, size - 25, 4).alias("bands"))


# --- definitions, states, records ------------------------------------------------------------

DEFINED = """, ld AS (SELECT m.*, d.text, CASE WHEN d.text IS NULL THEN 'no job.json' WHEN NOT json_valid(d.text) OR json_type(d.text) <> 'OBJECT' THEN 'job.json is not an object'
  WHEN json_extract_string(d.text, '$.job_key') <> m.job_key THEN 'job.json names another job'
  WHEN m.generation = 0 AND CAST(json_extract_string(d.text, '$.priority') AS INT) <> m.priority THEN 'job.json has another priority' END AS job_error FROM fx_marker m LEFT JOIN fx_document d ON d.job_key = m.job_key),
jd AS (SELECT job_id, job_key, kind, generation, record_ref, placement, priority, job_error, CASE WHEN job_error IS NULL THEN json_extract_string(text, '$.name') END AS name,
  CASE WHEN job_error IS NULL THEN json_extract_string(text, '$.workflow') END AS workflow, CASE WHEN job_error IS NULL THEN json_extract_string(text, '$.initial_step') END AS initial_step,
  CASE WHEN job_error IS NULL THEN json_extract_string(text, '$.runner.executor') END AS runner_executor, CASE WHEN job_error IS NULL THEN json_extract_string(text, '$.claim.pool') END AS claim_pool,
  CASE WHEN job_error IS NULL THEN CAST(json_extract_string(text, '$.retry.attempts') AS BIGINT) END AS max_attempts, CASE WHEN job_error IS NULL THEN sha256(text) END AS digest FROM ld)
"""
STATED = """, sd AS (SELECT m.job_id, r.*, CASE WHEN m.record_ref = 'init' THEN NULL WHEN r.record_ref IS NULL THEN 'no such record' WHEN r.is_error THEN 'record cannot be read'
  WHEN NOT (r.format = 'state' AND r.format_version = 2 AND r.workspace_id = 'ws' AND r.job_key = m.job_key AND r.generation = m.generation AND r.kind = m.kind) THEN 'state frame disagrees with marker' END AS state_error,
  m.record_ref = 'init' AS at_first, m.priority AS marker_priority
  FROM fx_marker m LEFT JOIN (SELECT * EXCLUDE (job_id) FROM fx_record) r ON r.record_ref = m.record_ref)
"""


@query("fx_marker", "fx_document", sql=DEFINED + "SELECT * EXCLUDE (placement, priority) FROM jd")
def load_jobs(markers, documents):
    return states.load_jobs(markers.select("job_id", "job_key", "kind", "generation", "record_ref", "priority"), documents).drop("priority")


@query(
    "fx_marker", "fx_record",
    sql=STATED + """SELECT job_id, state_error, CASE WHEN at_first THEN 'submitted' WHEN state_error IS NULL THEN kind END AS kind, CASE WHEN at_first THEN 0 WHEN state_error IS NULL THEN generation END AS generation,
CASE WHEN at_first THEN marker_priority END AS priority, CASE WHEN state_error IS NULL THEN step END AS step, CASE WHEN state_error IS NULL THEN reason END AS reason,
CASE WHEN state_error IS NULL THEN failure_code END AS failure_code FROM sd""",
)
def read_state(markers, records):
    read = states.read_states(markers, records, ["step", "reason", "failure_code"])
    return read.select("job_id", "state_error", "state.*")


@query(
    "fx_marker", "fx_record",
    sql=""", w AS (SELECT m.job_id, m.record_ref, 0 AS back, [m.record_ref] AS seen, CAST(NULL AS VARCHAR) AS error FROM fx_marker m WHERE m.record_ref <> 'init'
  UNION ALL SELECT w.job_id, r.previous_record_ref, w.back + 1, list_append(w.seen, r.previous_record_ref), CASE WHEN list_contains(w.seen, r.previous_record_ref) THEN 'the chain is cyclic' END
  FROM w JOIN fx_record r ON r.record_ref = w.record_ref WHERE w.error IS NULL AND NOT r.is_error AND r.previous_record_ref IS NOT NULL)
SELECT w.job_id, row_number() OVER (PARTITION BY w.job_id ORDER BY back DESC) AS position, w.record_ref,
  coalesce(w.error, CASE WHEN r.record_ref IS NULL THEN 'no such record' WHEN r.is_error THEN 'record cannot be read' END) AS error FROM w LEFT JOIN fx_record r ON r.record_ref = w.record_ref""",
)
def job_history(markers, records):
    return states.job_history(markers, records)


SPAWNED = """, sp AS (SELECT job_id, concat('l', cast(event_id % 4 AS VARCHAR)) AS label, event_id % 9 AS child FROM fx_frame)
"""


def _spawns(frames):
    label = F.concat(F.lit("l"), (F.col("event_id") % 4).cast("string"))
    return frames.select("job_id", label.alias("label"), (F.col("event_id") % 9).alias("child"), F.when(F.col("event_id") % 3 > 0, F.col("kind")).alias("kind"), F.col("generation").alias("position"))


@query(
    "fx_marker", "fx_document", "fx_frame", "fx_record", "fx_declaration",
    sql=DEFINED + STATED + ATTEMPTS + SPAWNED + """, dc AS (SELECT job_id, bool_or(observed IS NULL) AS damaged, count(DISTINCT declared) AS n FROM fx_declaration GROUP BY job_id)
SELECT jd.job_id, jd.name, jd.digest, sd.state_error, CASE WHEN sd.state_error IS NULL THEN sd.step END AS step, coalesce(f.n, 0) AS n_frames, coalesce(a.n, 0) AS n_attempts, coalesce(c.n, 0) AS n_children, coalesce(dc.n, 0) AS n_declarations,
  sd.state_error IS NOT NULL OR coalesce(f.damaged, false) OR coalesce(dc.damaged, false) AS gaps
FROM jd JOIN sd USING (job_id) LEFT JOIN (SELECT job_id, count(*) AS n, bool_or(is_error) AS damaged FROM fx_frame GROUP BY job_id) f USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n FROM t GROUP BY job_id) a USING (job_id) LEFT JOIN (SELECT job_id, count(DISTINCT label) AS n FROM sp GROUP BY job_id) c USING (job_id) LEFT JOIN dc USING (job_id)
WHERE jd.job_error IS NULL""",
)
def record_of(markers, documents, frames, records, declarations):
    declared = declarations.select("job_id", "declared", F.col("observed").isNull().alias("damaged"))
    made = states.records_of(markers, documents, records, _spawns(frames), declared)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return made.select(
        "job_id", "name", "digest", "state_error", "state.step", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), F.when(F.col("attempts").isNull(), 0).otherwise(size("attempts")).alias("n_attempts"),
        F.when(F.col("children").isNull(), 0).otherwise(size("children")).alias("n_children"), F.when(F.col("declarations").isNull(), 0).otherwise(size("declarations")).alias("n_declarations"), "gaps",
    )


@query(
    "fx_marker", "fx_document", "fx_record", "fx_job", "documents",
    sql=DEFINED + STATED + """, hl AS (SELECT doc_id AS job_id, split_part(text, chr(10), 1) AS headline FROM documents)
SELECT jd.job_id, jd.job_key, jd.kind AS state_kind, jd.placement, jd.priority, jd.generation, jd.record_ref, s.step, s.reason, s.created_at, s.activation_id, s.attempt_id, s.failure_code,
  CASE WHEN jd.kind IN ('claimed', 'running', 'committing') THEN s.manager_id END AS owner, jd.name, jd.workflow, jd.initial_step, jd.digest,
  CASE WHEN jd.job_error IS NULL THEN coalesce(j.attempts + 1 > jd.max_attempts, false) END AS budget_exhausted, hl.headline, jd.job_error, s.state_error
FROM jd JOIN (SELECT job_id, state_error, CASE WHEN state_error IS NULL THEN step END AS step, CASE WHEN state_error IS NULL THEN reason END AS reason, CASE WHEN state_error IS NULL THEN created_at END AS created_at,
    CASE WHEN state_error IS NULL THEN activation_id END AS activation_id, CASE WHEN state_error IS NULL THEN attempt_id END AS attempt_id, CASE WHEN state_error IS NULL THEN failure_code END AS failure_code,
    CASE WHEN state_error IS NULL THEN manager_id END AS manager_id FROM sd) s USING (job_id) JOIN fx_job j USING (job_id) LEFT JOIN hl USING (job_id)""",
)
def job_show(markers, documents, records, jobs, texts):
    headlines = texts.select(F.col("doc_id").alias("job_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("headline"))
    return states.describe_jobs(markers, documents, records, jobs.select("job_id", "attempts"), headlines)


@query(
    "fx_record", "fx_marker", "fx_document",
    sql=DEFINED + STATED + """, q AS (SELECT job_id, coalesce(nullif(CASE WHEN job_id % 4 = 0 THEN '' ELSE step END, ''), initial_step) AS step FROM jd JOIN (SELECT job_id, step FROM sd WHERE state_error IS NULL) s USING (job_id)
  WHERE job_id % 5 > 0 AND jd.job_error IS NULL)
SELECT job_id, step, 'step ' || chr(39) || step || chr(39) || ' is not one of the runner''s recorded steps: s0, s1, s4' AS finding FROM q WHERE step NOT IN ('s0', 's1', 's4')""",
)
def step_findings(records, markers, documents):
    steps = F.when(F.col("job_id") % 5 > 0, F.array(*map(F.lit, ("s0", "s1", "s4"))))
    read = states.read_states(markers, records, ["step"]).where("state_error IS NULL").select("job_id", F.when(F.col("job_id") % 4 == 0, "").otherwise(F.col("state.step")).alias("step"))
    defined = states.load_jobs(markers, documents).where("job_error IS NULL").select("job_id", "initial_step")
    return states.step_findings(read.join(defined, "job_id").withColumn("runner_steps", steps))


@query(
    "fx_job",
    sql="""SELECT job_id, 'v' AS name, CASE WHEN problem IS NULL AND source <> 'unresolved' THEN CASE WHEN type = 'string' THEN v ELSE CAST(v AS JSON)::VARCHAR END WHEN type = 'string' THEN v END AS value, source, problem FROM (
SELECT *, CASE WHEN source = 'unresolved' THEN 'no layer sets it' WHEN type = 'string' THEN NULL WHEN NOT json_valid(v) THEN source || ' is not JSON for type ' || type
  WHEN (type = 'integer' AND json_type(v) IN ('UBIGINT', 'BIGINT')) OR (type = 'boolean' AND json_type(v) = 'BOOLEAN') OR (type = 'array' AND json_type(v) = 'ARRAY') THEN NULL ELSE source || ' does not match type ' || type END AS problem
FROM (SELECT job_id, CASE job_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'boolean' ELSE 'array' END AS type,
  CASE WHEN job_id % 3 = 0 THEN o WHEN job_id % 5 = 0 THEN e ELSE w END AS v, CASE WHEN job_id % 3 = 0 THEN 'override' WHEN job_id % 5 = 0 THEN 'environment' WHEN w IS NOT NULL THEN 'workspace' ELSE 'unresolved' END AS source
  FROM (SELECT job_id, CASE job_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN '[1,2]' ELSE CAST(job_id AS VARCHAR) END AS o, CASE job_id % 11 WHEN 0 THEN '{' ELSE 'false' END AS e, CASE WHEN job_id % 2 = 0 THEN pool END AS w FROM fx_job)))""",
)
def environment_findings(jobs):
    job = F.col("job_id")
    wanted = jobs.select(
        "job_id",
        F.lit("v").alias("name"),
        F.element_at(F.array(*map(F.lit, ("string", "integer", "boolean", "array"))), (job % 4 + 1).cast("int")).alias("type"),
        F.when(job % 3 == 0, F.when(job % 7 == 0, "true").when(job % 7 == 1, "[1,2]").otherwise(job.cast("string"))).alias("override"),
        F.when(job % 5 == 0, F.when(job % 11 == 0, "{").otherwise("false")).alias("environment"),
        F.when(job % 2 == 0, F.col("pool")).alias("workspace"),
    )
    return states.environment_findings(wanted, [(c, c) for c in ("override", "environment", "workspace")])


@query(
    "fx_child", "fx_job",
    sql=""", r AS (SELECT DISTINCT parent_id, line, CASE WHEN line % 4 = 1 THEN NULL ELSE child_id END AS job_id, CASE WHEN line % 4 = 2 OR line % 12 = 1 THEN NULL ELSE 'o--' || supp END AS job_key, CASE WHEN line % 3 = 0 THEN supp END AS supp FROM fx_child),
h AS (SELECT r.*, j.placement AS placement_hint FROM r LEFT JOIN fx_job j ON j.job_id = r.supp)
SELECT h.parent_id, h.line AS position, 'l' || h.line AS label, h.job_id, coalesce(a.job_key, b.job_key, h.job_key) AS job_key, coalesce(a.placement, b.placement) AS placement, coalesce(a.kind, b.kind) AS kind,
  coalesce(a.kind, b.kind) IN ('succeeded', 'failed', 'cancelled') AS terminal, CASE WHEN h.job_id IS NULL AND h.job_key IS NULL THEN 'child reference is not an object' END AS error
FROM h LEFT JOIN fx_job a ON a.job_key = h.job_key AND a.placement = h.placement_hint LEFT JOIN fx_job b ON b.job_id = h.job_id""",
)
def observe_join(children, jobs):
    line = F.col("line")
    named = children.select(
        "parent_id", line.alias("position"), F.concat(F.lit("l"), line.cast("string")).alias("label"), F.when(line % 4 != 1, F.col("child_id")).alias("job_id"),
        F.when((line % 4 != 2) & (line % 12 != 1), F.concat(F.lit("o--"), F.col("supp").cast("string"))).alias("job_key"), F.when(line % 3 == 0, F.col("supp")).alias("_at"),
    ).distinct()
    hints = jobs.select(F.col("job_id").alias("_at"), F.col("placement").alias("placement_hint"))
    return joins.observe_join(named.join(hints, "_at", "left").drop("_at"), jobs)


@query(
    "fx_child",
    sql=""", c AS (SELECT DISTINCT parent_id, line, child_id FROM fx_child QUALIFY row_number() OVER (PARTITION BY parent_id, child_id ORDER BY line) = 1)
SELECT parent_id, child_id AS job_key, CASE WHEN line % 2 = 0 THEN 'own' WHEN line % 3 > 0 THEN 's' || child_id END AS label FROM c""",
)
def labeled_join(children):
    first = children.groupBy("parent_id", "child_id").agg(F.min("line").alias("line"))
    references = first.select("parent_id", F.col("child_id").alias("job_key"), F.when(F.col("line") % 2 == 0, "own").alias("label"))
    spawned = first.where("line % 3 > 0").select("parent_id", F.col("child_id").alias("job_key"), F.concat(F.lit("s"), F.col("child_id").cast("string")).alias("label"))
    return joins.labeled_join(references, spawned)


@query(
    "fx_job", "fx_frame",
    sql="""SELECT j.job_id AS child_id, j.kind, CASE WHEN j.kind IN ('failed', 'cancelled') THEN f.failure_code END AS failure_code, CASE WHEN j.job_id % 5 = 1 THEN j.placement || '/w' WHEN j.job_id % 5 > 1 AND f.attempt_id IS NOT NULL THEN j.placement || '/w.' || f.attempt_id
  WHEN f.job_id IS NOT NULL THEN j.placement || '/old' END AS workdir_path, f.generation AS data_generation
FROM fx_job j LEFT JOIN (SELECT * FROM fx_frame QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1) f ON f.job_id = j.job_id""",
)
def child_evidence(jobs, frames):
    current = frames.groupBy(F.col("job_id").alias("child_id")).agg(F.max_by(F.struct("attempt_id", "failure_code"), "generation").alias("f"), F.max("generation").alias("data_generation"))
    current = current.select("child_id", "f.*", F.lit("old").alias("workdir"), "data_generation")
    mode = F.when(F.col("job_id") % 5 == 1, "persistent").otherwise("isolated")
    defined = jobs.where("job_id % 5 > 0").select(F.col("job_id").alias("child_id"), mode.alias("workdir_mode"), F.lit("w").alias("workdir_path"))
    return joins.child_evidence(jobs.select(F.col("job_id").alias("child_id"), "kind", F.col("placement").alias("payload")), current, defined)


@query(
    "fx_child",
    sql=""", o AS (SELECT parent_id AS run_id, line AS label, any_value(child_id) AS target FROM (SELECT * FROM fx_child WHERE line % 2 = 1 ORDER BY ALL) GROUP BY ALL),
c AS (SELECT parent_id AS run_id, line AS label, min(child_id) AS entry FROM fx_child WHERE line % 2 = 1 GROUP BY ALL), i AS (SELECT parent_id AS run_id, line AS label, min(supp) AS entry FROM fx_child WHERE line % 3 = 0 GROUP BY ALL)
SELECT c.run_id, c.label AS role, c.label - 2 AS product_of, coalesce(i.entry, p.entry) AS source, c.entry AS target FROM c LEFT JOIN i ON i.run_id = c.run_id AND i.label = c.label - 2 LEFT JOIN c p ON p.run_id = c.run_id AND p.label = c.label - 2""",
)
def products(children):
    out = children.where("line % 2 = 1").groupBy(F.col("parent_id").alias("run_id"), F.col("line").alias("label")).agg(F.min("child_id").alias("entry"))
    given = children.where("line % 3 = 0").groupBy(F.col("parent_id").alias("run_id"), F.col("line").alias("label")).agg(F.min("supp").alias("entry"))
    roles = out.select("run_id", F.col("label").alias("role"), (F.col("label") - 2).alias("product_of"))
    return states.products(out, given, roles)


@query("fx_child", sql="SELECT parent_id AS run_id, count(*) FILTER (WHERE line % 3 = 0) AS inputs, count(*) FILTER (WHERE line % 3 = 1) AS artifacts, count(*) FILTER (WHERE line % 3 = 2) AS outputs FROM fx_child GROUP BY parent_id")
def edge_counts(children):
    direction = F.element_at(F.array(*map(F.lit, ("input", "artifact", "output"))), (F.col("line") % 3 + 1).cast("int"))
    return states.edge_counts(children.select(F.col("parent_id").alias("run_id"), direction.alias("direction")))


# --- values that flow ------------------------------------------------------------------------


@query(
    "orders",
    sql="""SELECT o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'n=' || o_orderkey || ' in ' || o_orderpriority || '; ' ELSE 'plain $(other.x)' END AS resolved,
CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS whole FROM orders""",
)
def parameter_references(orders):
    text = F.element_at(F.array(*map(F.lit, ("$(inputs.a.n)", "n=$(inputs.a.n) in $(runtime.p); $(inputs.none)", "plain $(other.x)"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = orders.select(F.col("o_orderkey").alias("run_id"), text.alias("text"))
    bound = lambda space, path, value: orders.select(F.col("o_orderkey").alias("run_id"), F.lit(space).alias("namespace"), F.lit(path).alias("path"), F.parse_json(F.to_json(F.struct(value.alias("v")))).alias("d"))
    bindings = bound("inputs", "a.n", F.col("o_orderkey")).unionByName(bound("runtime", "p", F.col("o_orderpriority")))
    bindings = bindings.select("run_id", "namespace", "path", F.variant_get("d", "$.v", "variant").alias("value"))
    made = dataflow.interpolated(rows, "run_id", "text", bindings)
    return made.select("run_id", "resolved", F.to_json("whole").alias("whole"))


@query(
    "fx_child",
    sql=""", v AS (SELECT parent_id, line, CASE line % 3 WHEN 0 THEN CAST(min(child_id) AS VARCHAR) WHEN 1 THEN '[' || min(child_id) || ',' || min(supp) || ']' END AS value FROM fx_child GROUP BY parent_id, line)
SELECT parent_id AS run_id, 'one' AS name, value FROM v WHERE line = 1
UNION ALL SELECT parent_id, 'flat', '[' || coalesce(string_agg(trim(value, '[]'), ',' ORDER BY line), '') || ']' FROM v GROUP BY parent_id
UNION ALL SELECT parent_id, 'each', '[' || string_agg(coalesce(value, 'null'), ',' ORDER BY line) || ']' FROM v WHERE line <= 2 GROUP BY parent_id HAVING count(*) = 2""",
)
def workflow_outputs(children):
    folded = children.groupBy(F.col("parent_id").alias("run_id"), F.col("line").alias("source")).agg(F.min("child_id").cast("string").alias("c"), F.min("supp").cast("string").alias("s"))
    value = F.when(F.col("source") % 3 == 0, F.col("c")).when(F.col("source") % 3 == 1, F.concat(F.lit("["), "c", F.lit(","), "s", F.lit("]")))
    values = folded.select("run_id", "source", value.alias("value"))
    named = lambda rows, name, merge: rows.select("run_id", F.lit(name).alias("name"), F.col("source").alias("ordinal"), "source", F.lit(merge).cast("string").alias("merge"))
    two = folded.where("source <= 2").join(folded.where("source <= 2").groupBy("run_id").count().where("count = 2"), "run_id", "left_semi")
    declared = named(folded.where("source = 1"), "one", None).unionByName(named(folded, "flat", "merge_flattened")).unionByName(named(two, "each", None))
    return dataflow.workflow_outputs(declared, values)


NODES = """, nd AS (SELECT node, CASE WHEN node % 7 = 0 THEN 'input' WHEN node % 11 = 3 THEN 'output' ELSE 'function' END AS type FROM (SELECT child AS node FROM fx_edge UNION SELECT parent FROM fx_edge) WHERE node % 53 <> 1),
ed AS (SELECT parent AS source, child AS target, CASE WHEN child % 11 = 3 AND parent % 4 > 0 THEN NULL WHEN child % 13 = 5 THEN NULL WHEN child % 17 = 2 THEN '' ELSE 'p' || parent % 2 END AS port FROM fx_edge)
"""


def _graph(edges):
    node = F.col("node")
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct().where("node % 53 <> 1")
    nodes = nodes.withColumn("type", F.when(node % 7 == 0, "input").when(node % 11 == 3, "output").otherwise("function"))
    child, parent = F.col("child"), F.col("parent")
    port = F.when((child % 11 == 3) & (parent % 4 > 0), None).when(child % 13 == 5, None).when(child % 17 == 2, "").otherwise(F.concat(F.lit("p"), (parent % 2).cast("string")))
    return nodes, edges.select(parent.alias("source"), child.alias("target"), port.alias("port"))


@query(
    "fx_edge",
    sql=NODES + """SELECT * FROM (SELECT e.source, e.target, e.port, CASE WHEN s.type IS NULL THEN 'source is no declared node' WHEN t.type IS NULL THEN 'target is no declared node' WHEN e.port = '' THEN 'port is empty'
  WHEN t.type = 'input' THEN 'an input node takes no inputs' WHEN s.type = 'output' THEN 'an output node produces nothing' WHEN t.type = 'function' AND e.port IS NULL THEN 'a function''s edge names no parameter'
  WHEN t.type = 'output' AND e.port IS NOT NULL THEN 'an output''s edge names a parameter' WHEN count(*) OVER (PARTITION BY e.target, coalesce(e.port, '')) > 1 THEN 'two edges feed one parameter' END AS fault
FROM ed e LEFT JOIN nd s ON s.node = e.source LEFT JOIN nd t ON t.node = e.target) WHERE fault IS NOT NULL""",
)
def edge_faults(edges):
    return dataflow.edge_faults(*_graph(edges))


@query("fx_edge", sql=NODES + "SELECT node FROM nd WHERE type = 'output' AND node NOT IN (SELECT target FROM ed WHERE port IS NULL)")
def unfed_outputs(edges):
    return dataflow.unfed_outputs(*_graph(edges))


@query(
    "fx_edge",
    sql=NODES + """SELECT target AS node, port, CASE WHEN source % 2 = 0 THEN '{"a":' || source || ',"b":[1]}' WHEN source % 3 = 0 THEN '[1]' WHEN source % 5 > 0 THEN CAST(source AS VARCHAR) END AS value FROM ed""",
)
def node_arguments(edges):
    _, named = _graph(edges)
    source = F.col("source")
    port = F.when((source % 2 > 0) & (source % 3 == 0), "b").when((source % 2 > 0) & (source % 5 > 0), "a").when(source % 2 > 0, "none")
    result = F.concat(F.lit('{"a":'), F.col("node").cast("string"), F.lit(',"b":[1]}'))
    return dataflow.node_arguments(named.withColumn("source_port", port), edges.select(F.col("parent").alias("node")).distinct().withColumn("result", result))


@query("customer", sql="SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'north' ELSE 'south' END AS partition FROM customer")
def campaign_round_robin(customers):
    return dataflow.dealt_round_robin(customers.select("c_custkey", F.col("c_custkey").alias("n")), "n", ["east", "north", "south"]).drop("n")


@query(
    "customer",
    sql="SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN CASE c_custkey % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'north' END END AS partition, CASE WHEN c_custkey % 5 = 0 THEN 'not assigned' WHEN c_custkey % 4 = 1 THEN 'no such partition' END AS fault FROM customer",
)
def campaign_explicit(customers):
    name = F.when(F.col("c_custkey") % 4 == 0, "east").when(F.col("c_custkey") % 4 == 1, "west").otherwise("north")
    return dataflow.dealt_explicitly(customers.select("c_custkey"), "c_custkey", customers.where("c_custkey % 5 > 0").select("c_custkey", name.alias("partition")), ["east", "north"])


@query(
    "customer",
    sql="SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'd' END AS a, 'e' AS b, CASE WHEN c_custkey % 3 < 2 THEN c_mktsegment END AS c FROM customer",
)
def campaign_items(customers):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    inputs = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("a"), name, F.lit("c"), segment)).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("c"), segment)).otherwise(F.create_map(F.lit("a"), F.lit(None).cast("string")))
    merged = dataflow.merged_items(customers.select("c_custkey", inputs.alias("inputs")), {"a": "d", "b": "e"}, "c_custkey")
    return merged.select("c_custkey", *[F.try_element_at("inputs", F.lit(k)).alias(k) for k in "abc"])


# --- composed reports ----------------------------------------------------------------------

COLLECTED = ATTEMPTS + """, r AS (SELECT j.job_id, j.kind, coalesce(g.n, 0) AS n_frames, coalesce(g.gaps, false) AS gaps, coalesce(x.n_attempts, 0) AS n_attempts, coalesce(x.n_failures, 0) AS n_failures, x.last_finished
FROM fx_job j LEFT JOIN (SELECT job_id, count(*) AS n, bool_or(is_error) AS gaps FROM fx_frame GROUP BY job_id) g USING (job_id)
LEFT JOIN (SELECT job_id, count(*) AS n_attempts, count(failure_code) AS n_failures, max(finished_at) AS last_finished FROM t GROUP BY job_id) x USING (job_id)
WHERE j.kind IN ('succeeded', 'failed', 'cancelled'))
"""


def _records(jobs, frames):
    return collect.collect_records(jobs, frames, ["succeeded", "failed", "cancelled"])


@query("fx_job", "fx_frame", sql=COLLECTED + "SELECT * FROM r")
def collect_records(jobs, frames):
    return collect.record_summary(_records(jobs, frames))


@query(
    "fx_job", "fx_frame",
    sql=COLLECTED + "SELECT count(*) AS collected, count(*) FILTER (WHERE gaps OR n_frames = 0) AS degraded, CAST(coalesce(sum(n_attempts), 0) AS BIGINT) AS attempts, CAST(coalesce(sum(n_failures), 0) AS BIGINT) AS failures FROM r",
)
def collect_summary(jobs, frames):
    return collect.collect_summary(_records(jobs, frames))


@query(
    "fx_job", "fx_manager", "fx_join", "fx_child",
    sql=REFUSAL + VERDICT + """, b AS (SELECT executor, pool, capabilities, area, count(*) FILTER (WHERE refused = 0) AS n_eligible FROM p GROUP BY ALL),
x AS (SELECT j.job_id, j.kind, list_filter([CASE WHEN kind = 'submitted' THEN 'not registered' END,
  CASE WHEN kind = 'ready' AND coalesce(n_eligible, 0) = 0 THEN 'no manager could claim it' END,
  CASE WHEN kind = 'ready' AND attempts + 1 > max_attempts THEN 'attempts of this activation used up' END,
  CASE WHEN kind = 'ready' AND total_attempts + 1 > max_total THEN 'total attempts used up' END,
  CASE WHEN kind = 'waiting' AND verdict IS NULL THEN 'children unknown' END,
  CASE WHEN kind = 'waiting' AND verdict <> 'satisfied' THEN 'children ' || verdict END,
  CASE WHEN kind = 'paused' THEN 'paused by an operator' END], lambda c: c IS NOT NULL) AS checks
FROM fx_job j LEFT JOIN b ON j.executor = b.executor AND j.pool = b.pool AND j.capabilities = b.capabilities AND array_to_string(string_split(j.placement, '/')[1:2], '/') = b.area LEFT JOIN v ON v.parent_id = j.job_id)
SELECT job_id, kind, len(checks) > 0 AND kind NOT IN ('succeeded', 'failed', 'cancelled') AS blocked, array_to_string(checks, '; ') AS checks FROM x""",
)
def explain_job(jobs, managers, waits, children):
    return reports.explain_jobs(jobs, managers, joins.join_verdicts(waits, children))


PRECHECK = REFUSAL.replace("WHERE kind = 'ready' GROUP BY ALL", "WHERE kind IN ('submitted', 'ready') GROUP BY ALL") + """, b AS (SELECT executor, pool, capabilities, area, count(*) FILTER (WHERE refused = 0) AS n_eligible FROM p GROUP BY ALL),
q AS (SELECT j.job_id, coalesce(n_eligible, 0) = 0 AS no_manager, j.executor <> 'path' AS legacy_executor, d.declared IS NOT NULL AND d.observed IS NULL AS input_missing, coalesce(attempts + 1 > max_attempts, false) AS budget_used
FROM fx_job j LEFT JOIN b ON j.executor = b.executor AND j.pool = b.pool AND j.capabilities = b.capabilities AND array_to_string(string_split(j.placement, '/')[1:2], '/') = b.area
LEFT JOIN fx_declaration d ON d.job_id = j.job_id WHERE kind IN ('submitted', 'ready'))
"""


@query("fx_job", "fx_manager", "fx_declaration", sql=PRECHECK + "SELECT * FROM q")
def precheck(jobs, managers, declarations):
    return reports.readiness(jobs, managers, declarations)


@query(
    "fx_job", "fx_manager", "fx_declaration",
    sql=PRECHECK + """SELECT count(*) AS jobs, count(*) FILTER (WHERE no_manager) AS no_manager, count(*) FILTER (WHERE legacy_executor) AS legacy_executor,
count(*) FILTER (WHERE input_missing) AS input_missing, count(*) FILTER (WHERE budget_used) AS budget_used FROM q""",
)
def precheck_summary(jobs, managers, declarations):
    return reports.readiness_summary(reports.readiness(jobs, managers, declarations))


@query(
    "fx_frame",
    sql="""SELECT job_id, max(generation) AS generation, arg_max(kind, generation) AS kind, count(*) FILTER (WHERE kind = 'claimed') AS n_claims, count(*) FILTER (WHERE kind = 'failed') AS n_failures FROM fx_frame GROUP BY job_id""",
)
def stream_replay_state(frames):
    """The frames written as files, replayed as a stream through the keyed state machine."""
    # A job's frames lie in one part in order, in files of bounded size; a micro-batch takes some of them.
    folder = scratch_folder(frames.sparkSession, "replay")
    rows = frames.select("job_id", "generation", "kind")
    rows.repartition("job_id").sortWithinPartitions("generation").write.option("maxRecordsPerFile", 200_000).parquet(f"{folder}/frames")
    return state_machine.replay(frames.sparkSession, f"{folder}/frames", rows.schema, f"{folder}/checkpoint", most_batches=8)


from . import diagnosis_queries, record_queries, upkeep_queries  # noqa: E402, F401  register their queries here


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
