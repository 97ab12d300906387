"""Queries of why jobs stand still and what may be transferred, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import census
from .plans import diagnosis, transfers
from .queries import AREA, query
from .schemas import TERMINAL_KINDS

CURRENT = f""", live AS (SELECT * FROM fx_manager WHERE heartbeat_age_seconds <= 900),
j AS (SELECT *, {AREA} AS area, CASE WHEN NOT readable THEN 'unreadable' END AS job_error, coalesce(attempts + 1 > max_attempts, false) OR coalesce(total_attempts + 1 > max_total, false) AS spent,
  'activation ' || attempts || ' of ' || coalesce(CAST(max_attempts AS VARCHAR), 'unlimited') AS one, 'total ' || total_attempts || ' of ' || coalesce(CAST(max_total AS VARCHAR), 'unlimited') AS two FROM fx_job),
ch AS (SELECT c.parent_id AS job_id, c.line AS place, 'l' || c.line AS label, CASE WHEN c.resolved THEN c.kind END AS child_kind, c.resolved AND c.kind IN ('succeeded', 'failed', 'cancelled') AS terminal,
  CASE WHEN c.resolved AND c.kind = 'failed' THEN 'code' || c.line END AS failure, p.kind FROM fx_child c JOIN fx_job p ON p.job_id = c.parent_id),
w AS (SELECT j.*, s.* EXCLUDE (job_id), m.manager_id IS NOT NULL AS owner_known, m.heartbeat_age_seconds AS owner_age, coalesce(s.lease_seconds, 900) AS lease,
  coalesce(m.heartbeat_age_seconds <= coalesce(s.lease_seconds, 900), false) AS owner_alive, n.n_children, n.n_terminal, n.n_unresolved
  FROM j LEFT JOIN fx_current s ON s.job_id = j.job_id LEFT JOIN fx_manager m ON m.manager_id = s.manager_id
  LEFT JOIN (SELECT job_id, count(*) AS n_children, count(*) FILTER (WHERE terminal) AS n_terminal, count(*) FILTER (WHERE child_kind IS NULL) AS n_unresolved FROM ch WHERE kind = 'waiting' GROUP BY job_id) n ON n.job_id = j.job_id)
"""
FOREIGN = "(kind = 'running' AND NOT owner_alive AND job_error IS NULL AND persistent AND coalesce(writer_host <> 'h0', false))"


def _inputs(jobs, children):
    """Jobs with the error of their definition; children of waiting jobs as observed, others as recorded."""
    judged = jobs.withColumn("job_error", F.when(~F.col("readable"), "unreadable"))
    seen = F.col("resolved")
    born = children.join(jobs.select(F.col("job_id").alias("parent_id"), (F.col("kind") == "waiting").alias("observed")), "parent_id").select(
        "parent_id", F.col("line").cast("long").alias("place"), F.concat(F.lit("l"), F.col("line").cast("string")).alias("label"),
        F.when(seen, F.col("kind")).alias("child_kind"), (seen & F.col("kind").isin(*TERMINAL_KINDS)).alias("terminal"),
        F.when(seen & (F.col("kind") == "failed"), F.concat(F.lit("code"), F.col("line").cast("string"))).alias("failure"), "observed",
    )
    return judged, born


@query(
    "fx_job", "fx_current", "fx_manager", "fx_child",
    sql=CURRENT + f"""SELECT job_id, kind, NOT (kind = 'succeeded' OR (kind IN ('claimed', 'running', 'cancelling') AND owner_alive) OR (kind = 'committing' AND coalesce(wedge, '') = '')
  OR (kind = 'waiting' AND coalesce(n_children = n_terminal, false))) AS blocked,
  CASE WHEN kind = 'submitted' THEN 'not registered' WHEN kind = 'ready' THEN 'to be claimed' WHEN kind = 'running' AND owner_alive THEN 'progressing' WHEN {FOREIGN} THEN 'written on ' || writer_host
    WHEN kind = 'running' THEN 'to be recovered' WHEN kind = 'committing' AND coalesce(wedge, '') <> '' THEN 'commit keeps failing' WHEN kind = 'committing' THEN 'to be committed'
    WHEN kind = 'waiting' AND n_children IS NULL THEN 'no readable child' WHEN kind = 'waiting' AND n_unresolved > 0 THEN n_unresolved || ' unresolved, grace ' || coalesce('since ' || unresolved_since, 'not begun')
    WHEN kind = 'waiting' AND n_terminal < n_children THEN (n_children - n_terminal) || ' of ' || n_children || ' not terminal' WHEN kind = 'waiting' THEN 'to be joined'
    WHEN kind = 'failed' THEN coalesce(failure_code, 'no failure record') WHEN kind = 'paused' THEN 'paused' WHEN kind = 'cancelling' THEN 'to be cancelled' ELSE 'done' END AS summary FROM w""",
)
def job_diagnosis(jobs, states, managers, children):
    judged, born = _inputs(jobs, children)
    return diagnosis.job_diagnosis(judged, states, managers, born, host="h0")


def _listed(name: str, kinds: str, applies: str, passed: str, detail: str, place: str = "0", source: str = "w") -> str:
    """The rows of one check."""
    test = f"kind IN ({', '.join(repr(k) for k in kinds.split())}) AND ({applies})" if kinds else applies
    return f"SELECT job_id, {diagnosis.ORDER[name]}::INT AS position, ({place})::BIGINT AS place, '{name}' AS name, ({passed})::BOOLEAN AS passed, {detail} AS detail FROM {source} WHERE {test}"


SERVED, TRIED, ASKED = "submitted ready committing waiting cancelling", "ready claimed running failed", "ready failed paused"
CHILD = "label || ' ' || coalesce(child_kind, 'unresolved') || coalesce(' ' || failure, '')"
HISTORY = """(SELECT job_id, kind, n, v, u, coalesce(step, '-') AS step FROM w JOIN (SELECT job_id, count(DISTINCT attempt_id) AS n, count(DISTINCT activation_id) AS v, count(*) FILTER (WHERE unclean_restart) AS u,
  arg_max(step, generation) FILTER (WHERE step IS NOT NULL) AS step FROM fx_record GROUP BY job_id) h USING (job_id))"""
GONE = """(SELECT job_id, kind, coalesce(reason, 'unknown') AS reason FROM (SELECT r.*, j.kind FROM fx_request r JOIN j USING (job_id) WHERE retired_at IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY retired_at DESC, request_id) = 1)"""
LISTED = [
    ("state frame", "", "state_error IS NOT NULL", "false", "state_error"),
    ("job definition", "", "job_error IS NOT NULL", "false", "job_error"),
    ("pause requested", "", "pause_by IS NOT NULL OR pause_reason IS NOT NULL", "NULL", "coalesce(pause_by, '-') || ': ' || coalesce(pause_reason, '-')"),
    ("commit", "committing", "wedge <> ''", "false", "wedge"),
    ("operator", "cancelling cancelled", "true", "NULL", "coalesce(operator, '-') || ': ' || coalesce(operator_reason, '-')"),
    ("fencing", "cancelling", "true", "true", "'no later outcome applies'"),
    ("owning manager", "claimed running committing cancelling", "true", "owner_alive", "CASE WHEN manager_id IS NULL THEN 'none recorded' WHEN NOT owner_known THEN manager_id || ' has no manifest' ELSE manager_id || ' age ' || owner_age || ' lease ' || lease END"),
    ("lease", "claimed running committing cancelling", "owner_known AND NOT owner_alive", "false", "'expired'"),
    ("persistent takeover", "", FOREIGN, "false", "writer_host"),
    ("termination evidence", "cancelling", "true", "NULL", "coalesce(evidence, '-')"),
    ("join condition", "waiting", "true", "NULL", "coalesce(condition, '-') || ' then ' || coalesce(next_step, '-')"),
    ("join child", "waiting", "true", "terminal", CHILD, "place", "ch"),
    ("failure", "failed", "failure_code IS NOT NULL", "false", "failure_code || ': ' || coalesce(failure_message, '-')"),
    ("dependency child", "failed", "child_kind IS DISTINCT FROM 'succeeded'", "false", CHILD, "place", "ch"),
    ("claim pool", "submitted ready", "readable", "NULL", "pool"),
    ("required capabilities", "submitted ready", "readable", "NULL", "capabilities"),
    ("runner executor", "submitted ready", "readable", "NULL", "executor"),
    ("registered manager", SERVED, "readable AND alive = 0", "false", "n || ' registered, none alive'", "0", "w, tot"),
    ("eligible manager", SERVED, "readable AND alive > 0", "k > 0", "k || ' of ' || alive", "0", "(SELECT job_id, kind, readable, coalesce(k, 0) AS k FROM w LEFT JOIN ac USING (job_id)), tot"),
    ("budget", "ready", "readable", "NOT spent", "one"),
    ("budget", "ready", "readable", "NOT spent", "two", "1"),
    ("maintenance lock", "ready", "true", "false", "'upgrade'"),
    ("error breadcrumb", "failed paused", "true", "CASE WHEN c.job_id IS NOT NULL THEN false END", "CASE WHEN c.job_id IS NULL THEN 'none' ELSE 'step ' || coalesce(step, '-') || ' raised ' || exception || ': ' || message END", "0", "(SELECT job_id, kind FROM w) a LEFT JOIN fx_breadcrumb c USING (job_id)"),
    ("operator continue", "failed paused", "true", "CASE WHEN activation_id IS NULL THEN false WHEN readable THEN NOT spent END", "CASE WHEN activation_id IS NULL THEN 'no activation' WHEN NOT readable THEN 'budget unknown' ELSE one || '; ' || two END"),
    ("attempt history", TRIED, "n > 0", "NULL", "n || ' in ' || v || ' at ' || step || ' unclean ' || u", "0", HISTORY),
    ("flapping", TRIED, "readable AND max_attempts IS NULL AND max_total IS NULL AND greatest(attempts, total_attempts) > 3", "false", "CAST(greatest(attempts, total_attempts) AS VARCHAR)"),
    ("pending request", ASKED, "retired_at IS NULL", "NULL", "request_id || ' ' || coalesce(action, '?') || ' by ' || coalesce(operator, '-')", "0", "(SELECT r.*, j.kind FROM fx_request r JOIN j USING (job_id))"),
    ("retired request", ASKED, "true", "NULL", "reason", "0", GONE),
]
ACCEPTING = """, tot AS (SELECT (SELECT count(*) FROM fx_manager) AS n, (SELECT count(*) FROM live) AS alive),
ac AS (SELECT j.job_id, g.k FROM j JOIN (SELECT c.*, count(*) AS k FROM (SELECT DISTINCT kind = 'ready' AS claims, executor, owner_uid, area, pool, capabilities, runner FROM j WHERE readable) c JOIN live m
  ON list_contains(string_split(m.executors, ','), c.executor) AND c.owner_uid = m.uid
  AND (m.placement_prefixes = '' OR len(list_filter(string_split(m.placement_prefixes, ','), lambda x: c.area = x OR starts_with(c.area, x || '/'))) > 0)
  AND (NOT claims OR ((m.accept_any_pool OR list_contains(string_split(m.pools, ','), c.pool))
    AND len(list_filter(string_split(c.capabilities, ','), lambda v: v <> '' AND NOT list_contains(string_split(m.capabilities, ','), v))) = 0
    AND (NOT starts_with(c.runner, 'pkg:') OR len(list_filter(string_split(m.runner_modules, ','), lambda x: x <> '' AND (c.runner[5:] = x OR starts_with(c.runner[5:], x || '.')))) > 0)
    AND (c.runner <> 'installed' OR m.searches))) GROUP BY ALL) g
  ON g.claims = (j.kind = 'ready') AND g.executor = j.executor AND g.owner_uid = j.owner_uid AND g.area = j.area AND g.pool = j.pool AND g.capabilities = j.capabilities AND g.runner = j.runner)
"""


@query(
    "fx_job", "fx_current", "fx_manager", "fx_record", "fx_child", "fx_request", "fx_breadcrumb",
    sql=CURRENT + ACCEPTING + "\nUNION ALL ".join(_listed(*c) for c in LISTED),
)
def job_checks(jobs, states, managers, frames, children, requests, breadcrumbs):
    judged, born = _inputs(jobs, children)
    history = census.attempt_history(frames)
    return diagnosis.job_checks(judged, states, managers, history, born, requests, breadcrumbs, host="h0", locked_by="upgrade", flapping=3)


OFFERED = """, w AS (SELECT DISTINCT child_id AS job_id FROM fx_child WHERE parent_id IN (SELECT job_id FROM fx_job WHERE kind = 'waiting')),
j AS (SELECT job_id, job_key, kind, placement, CASE WHEN NOT readable THEN 'unreadable' END AS problem FROM fx_job WHERE job_id % 8 <> 0),
l AS (SELECT * FROM fx_ledger WHERE status = 'sealed' AND destination_workspace_id = 'dest'),
c AS (SELECT job_id, job_key, prior_kind AS kind, placement, 'sealed' AS origin, problem FROM l WHERE coalesce(destination_remote, 'hub') = 'hub' AND prior_kind IN ('succeeded', 'failed', 'waiting') AND has_bundle
    AND (placement = 'r1' OR starts_with(placement, 'r1/')) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY transfer_id) = 1),
o AS (FROM c UNION ALL SELECT job_id, job_key, kind, placement, 'live', problem FROM j WHERE kind IN ('succeeded', 'failed') AND (placement = 'r1' OR starts_with(placement, 'r1/'))
    AND job_id NOT IN (SELECT job_id FROM c) AND job_id NOT IN (SELECT job_id FROM w))
"""
STATES = ["succeeded", "failed", "waiting"]


def _offer(jobs, children):
    """Jobs as they live (every eighth is gone) with the fault of their definition, and those that waiting joins name."""
    referenced = children.join(jobs.where("kind = 'waiting'").select(F.col("job_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("job_id"))
    return jobs.where("job_id % 8 <> 0").withColumn("problem", F.when(~F.col("readable"), "unreadable")), referenced


@query("fx_job", "fx_child", "fx_ledger", sql=OFFERED + "SELECT * FROM o")
def transfer_candidates(jobs, children, ledgers):
    live, referenced = _offer(jobs, children)
    return transfers.transfer_candidates(live, ledgers, referenced, "dest", STATES, placement="r1", remote="hub")


@query(
    "fx_job", "fx_child", "fx_ledger",
    sql=OFFERED + """, f AS (SELECT job_id, placement, prior_kind FROM l QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY transfer_id) = 1)
SELECT r.job_id, CASE WHEN o.problem IS NOT NULL THEN o.problem WHEN o.job_id IS NOT NULL THEN 'eligible'
  WHEN j.kind NOT IN ('submitted', 'ready', 'waiting', 'paused', 'failed', 'succeeded', 'cancelled') THEN 'not quiescent' WHEN j.kind NOT IN ('succeeded', 'failed', 'waiting') THEN 'filtered by state'
  WHEN NOT (j.placement = 'r1' OR starts_with(j.placement, 'r1/')) THEN 'filtered by placement' WHEN j.job_id IS NOT NULL AND (w.job_id IS NOT NULL OR j.kind = 'waiting') THEN 'blocked by join'
  WHEN j.job_id IS NOT NULL THEN 'not eligible' WHEN f.job_id IS NULL THEN 'not found' WHEN f.prior_kind IN ('succeeded', 'failed', 'waiting') AND NOT (f.placement = 'r1' OR starts_with(f.placement, 'r1/')) THEN 'filtered by placement'
  ELSE 'bundle unavailable' END AS reason
FROM (SELECT job_id + 100 AS job_id FROM fx_job) r LEFT JOIN o ON o.job_id = r.job_id LEFT JOIN j ON j.job_id = r.job_id LEFT JOIN w ON w.job_id = r.job_id LEFT JOIN f ON f.job_id = r.job_id""",
)
def transfer_reasons(jobs, children, ledgers):
    live, referenced = _offer(jobs, children)
    return transfers.transfer_reasons(jobs.select((F.col("job_id") + 100).alias("job_id")), live, ledgers, referenced, "dest", STATES, placement="r1", remote="hub")
