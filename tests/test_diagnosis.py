"""Checks of jobs, who would take them, and what may be transferred, against plain rules and hand cases."""

import random

import pytest
from pyspark.sql import functions as F

from stateloom.operators.predicates import pair_refusals
from stateloom.operators.upkeep import scan_order
from stateloom.plans import diagnosis, transfers

JOB = "job_id long, kind string, job_error string, placement string, executor string, pool string, capabilities string, owner_uid long, runner string, attempts long, total_attempts long, max_attempts long, max_total long"
STATE = (
    "job_id long, state_error string, manager_id long, lease_seconds long, activation_id string, persistent boolean, writer_host string, wedge string, failure_code string, failure_message string,"
    " condition string, next_step string, unresolved_since string, operator string, operator_reason string, evidence string, pause_by string, pause_reason string"
)
MANAGER = "manager_id long, executors string, pools string, accept_any_pool boolean, capabilities string, placement_prefixes string, uid long, searches boolean, runner_modules string, heartbeat_age_seconds long"
HISTORY = "job_id long, n_attempts long, n_activations long, last_step string, n_unclean long"
CHILD = "parent_id long, place long, label string, child_kind string, terminal boolean, failure string, observed boolean"
REQUEST = "job_id long, request_id string, action string, operator string, retired_at long, reason string"
CRUMB = "job_id long, step string, exception string, message string"


def rows(spark, schema, *dicts):
    """Rows of a schema from what is not null in them."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)


def checks(spark, jobs, states=(), managers=(), history=(), children=(), requests=(), crumbs=(), **options):
    made = (rows(spark, s, *d) for s, d in ((JOB, jobs), (STATE, states), (MANAGER, managers), (HISTORY, history), (CHILD, children), (REQUEST, requests), (CRUMB, crumbs)))
    found = diagnosis.job_checks(*made, host="here", **options).collect()
    return {j["job_id"]: [(r.name, r.passed, r.detail) for r in sorted(found, key=lambda r: (r.position, r.place, r.detail)) if r.job_id == j["job_id"]] for j in jobs}


def test_accepting_managers_equal_the_refusals_of_all_pairs(spark):
    rnd = random.Random(5)
    pick = lambda *names: ",".join(rnd.choice(names) for _ in range(rnd.randrange(4)))
    jobs = rows(spark, JOB, *[
        {"job_id": i, "placement": rnd.choice(["a", "a/b", "a/b/c", "ab", "a/bc"]), "executor": rnd.choice(["path", "legacy", ""]), "pool": rnd.choice(["p", "q"]),
         "capabilities": pick("x", "y", "z"), "owner_uid": rnd.choice([1, 2]), "runner": rnd.choice(["pkg:m", "pkg:m.n", "pkg:mn", "installed", ""])} for i in range(120)
    ])
    managers = rows(spark, MANAGER, *[
        {"manager_id": i, "executors": pick("path", "legacy"), "pools": pick("p", "q", "r"), "accept_any_pool": rnd.random() < 0.3, "capabilities": pick("x", "y", "z", "x"),
         "placement_prefixes": pick("a", "a/b", "ab", "a/b/c"), "uid": rnd.choice([1, 2]), "searches": rnd.random() < 0.5, "runner_modules": pick("m", "m.n", "k")} for i in range(150)
    ])
    pairs = jobs.select("job_id").join(managers.select("manager_id"))
    plain = pair_refusals(pairs, jobs, managers).where("size(reasons) = 0").groupBy("job_id").agg(F.count("*").alias("n"))
    found = diagnosis.accepting_managers(jobs, managers, diagnosis.TO_CLAIM, 3)
    expected = {tuple(r) for r in plain.collect()}
    assert len(expected) > 20 and {tuple(r) for r in found.collect()} == expected
    served = pair_refusals(pairs, jobs, managers).where(~F.exists("reasons", lambda r: r.rlike("^(owner|executor|placement) "))).groupBy("job_id").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in diagnosis.accepting_managers(jobs, managers, diagnosis.TO_SERVE, 3).collect()} == {tuple(r) for r in served.collect()}


def test_jobs_without_any_record(spark):
    kinds = ["submitted", "ready", "claimed", "running", "committing", "waiting", "paused", "failed", "cancelling", "succeeded", "cancelled", "strange", None]
    found = checks(spark, [{"job_id": i, "kind": k, "job_error": "unreadable" if k == "failed" else None} for i, k in enumerate(kinds)])
    names = {k: [c[0] for c in found[i]] for i, k in enumerate(kinds)}
    assert names["strange"] == names[None] == names["succeeded"] == []
    assert names["submitted"] == ["claim pool", "required capabilities", "runner executor", "registered manager"]
    assert names["ready"] == [*names["submitted"], "budget", "budget", "maintenance lock"]
    assert names["claimed"] == names["running"] == ["owning manager"]
    assert names["committing"] == ["owning manager", "registered manager"] and names["waiting"] == ["join condition", "registered manager"]
    assert names["cancelling"] == ["operator", "fencing", "owning manager", "termination evidence", "registered manager"]
    assert found[7] == [("job definition", False, "unreadable"), ("error breadcrumb", None, "none"), ("operator continue", False, "no activation")]
    assert checks(spark, []) == {}


def test_a_running_job_with_a_foreign_writer_and_many_requests(spark):
    jobs = [{"job_id": 1, "kind": "running"}, {"job_id": 2, "kind": "paused", "attempts": 2, "max_attempts": 2}, {"job_id": 3, "kind": "claimed", "attempts": 9}, {"job_id": 4, "kind": "running"}]
    states = [
        {"job_id": 1, "manager_id": 7, "lease_seconds": 10, "persistent": True, "writer_host": "there"},
        {"job_id": 2, "activation_id": "a"},
        {"job_id": 3, "manager_id": 7},
        {"job_id": 4, "manager_id": 8},
    ]
    requests = [
        {"job_id": 2, "request_id": "b", "action": "cancel", "operator": "me"}, {"job_id": 2, "request_id": "a"}, {"job_id": 1, "request_id": "a"},
        {"job_id": 2, "request_id": "d", "retired_at": 5, "reason": "late"}, {"job_id": 2, "request_id": "c", "retired_at": 5}, {"job_id": 2, "request_id": "0", "retired_at": 4, "reason": "old"},
    ]
    managers = [{"manager_id": 7, "heartbeat_age_seconds": 900}, {"manager_id": 8}]
    found = checks(spark, jobs, states, managers, requests=requests, flapping=8, history=[{"job_id": 3, "n_attempts": 2, "n_activations": 1, "n_unclean": 1}])
    assert found[1] == [("owning manager", False, "7 age 900 lease 10"), ("lease", False, "expired"), ("persistent takeover", False, "there")]
    assert found[2] == [
        ("error breadcrumb", None, "none"), ("operator continue", False, "activation 2 of 2; total 0 of unlimited"),
        ("pending request", None, "a ? by -"), ("pending request", None, "b cancel by me"), ("retired request", None, "unknown"),
    ]
    assert found[3] == [("owning manager", True, "7 age 900 lease 900"), ("attempt history", None, "2 in 1 at - unclean 1"), ("flapping", False, "9")]
    assert [c[:2] for c in found[4]] == [("owning manager", False), ("lease", False)]
    tables = [rows(spark, s, *d) for s, d in ((JOB, jobs), (STATE, states), (MANAGER, managers), (CHILD, []))]
    said = {r.job_id: (r.blocked, r.summary) for r in diagnosis.job_diagnosis(*tables, host="here").collect()}
    assert said == {1: (True, "written on there"), 2: (True, "paused"), 3: (False, "progressing"), 4: (True, "to be recovered")}


def test_children_of_waiting_and_failed_jobs(spark):
    jobs = [{"job_id": i, "kind": k} for i, k in enumerate(["waiting", "waiting", "failed", "waiting"])]
    children = [
        {"parent_id": 0, "place": 1, "label": "x", "child_kind": "failed", "terminal": True, "failure": "boom", "observed": True}, {"parent_id": 0, "place": 0, "child_kind": "running", "terminal": False, "observed": True},
        {"parent_id": 1, "place": 0, "child_kind": None, "observed": True}, {"parent_id": 1, "place": 1, "child_kind": "running", "terminal": False, "observed": True},
        {"parent_id": 2, "place": 0, "child_kind": "succeeded", "observed": False}, {"parent_id": 2, "place": 1, "child_kind": None, "observed": False}, {"parent_id": 2, "place": 2, "child_kind": "failed", "observed": True},
    ]
    found = checks(spark, jobs, children=children)
    assert [c for c in found[0] if c[0] == "join child"] == [("join child", False, "- running"), ("join child", True, "x failed boom")]
    assert [c for c in found[1] if c[0] == "join child"] == [("join child", False, "- unresolved"), ("join child", False, "- running")]
    assert [c for c in found[2] if "child" in c[0]] == [("dependency child", False, "- unresolved")]
    tables = [rows(spark, s, *d) for s, d in ((JOB, jobs), (STATE, [{"job_id": 1, "unresolved_since": "t"}]), (MANAGER, []), (CHILD, children))]
    said = {r.job_id: r.summary for r in diagnosis.job_diagnosis(*tables, host="here").collect()}
    assert said == {0: "1 of 2 not terminal", 1: "1 unresolved, grace since t", 2: "no failure record", 3: "no readable child"}


LEDGER = "job_id long, transfer_id string, job_key string, status string, destination_workspace_id string, destination_remote string, prior_kind string, placement string, has_bundle boolean, problem string"


def ledger(job_id, transfer_id, **other):
    return {"job_id": job_id, "transfer_id": transfer_id, "job_key": f"k{job_id}", "status": "sealed", "destination_workspace_id": "d", "prior_kind": "failed", "placement": "a/b", "has_bundle": True} | other


def test_transfers(spark):
    ledgers = rows(
        spark, LEDGER,
        ledger(1, "b"), ledger(1, "a", has_bundle=False), ledger(2, "a", destination_remote="r"), ledger(2, "b", problem="torn"), ledger(3, "a", status="received"),
        ledger(4, "a", placement="ab"), ledger(5, "a", prior_kind="paused"), ledger(6, "a", has_bundle=False), ledger(7, "a", destination_workspace_id="e"), ledger(9, "a"),
    )
    jobs = rows(
        spark, "job_id long, job_key string, kind string, placement string, problem string",
        *[{"job_id": i, "job_key": f"k{i}", "kind": k, "placement": p, "problem": b} for i, k, p, b in (
            (9, "failed", "a", None), (10, "failed", "a", None), (11, "failed", "a", "unreadable"), (12, "waiting", "a", None), (13, "running", "a", None), (14, "paused", "a", None), (15, "failed", "b", None), (16, "failed", "a", None))],
    )
    referenced = spark.createDataFrame([(16,), (16,)], "job_id long")
    states = ["failed", "waiting", "failed"]
    offer = lambda **o: [tuple(r) for r in transfers.transfer_candidates(jobs, ledgers, referenced, "d", states, placement="a", **o).collect()]
    assert offer() == [
        (10, "k10", "failed", "a", "live", None), (11, "k11", "failed", "a", "live", "unreadable"),
        (1, "k1", "failed", "a/b", "sealed", None), (2, "k2", "failed", "a/b", "sealed", None), (9, "k9", "failed", "a/b", "sealed", None),
    ]
    assert [r[0] for r in offer(wanted=spark.createDataFrame([(2,), (10,), (77,)], "job_id long"))] == [10, 2]
    assert [r[5] for r in offer(remote="s") if r[0] == 2] == ["torn"]
    reasons = {r.job_id: r.reason for r in transfers.transfer_reasons(spark.range(1, 18).withColumnRenamed("id", "job_id"), jobs, ledgers, referenced, "d", states, placement="a", remote="s").collect()}
    assert reasons == {
        1: "eligible", 2: "torn", 3: "not found", 4: "filtered by placement", 5: "bundle unavailable", 6: "bundle unavailable", 7: "not found", 8: "not found", 9: "eligible", 10: "eligible", 11: "unreadable",
        12: "blocked by join", 13: "not quiescent", 14: "filtered by state", 15: "filtered by placement", 16: "blocked by join", 17: "not found",
    }
    for bad in ([], ["running"]):
        with pytest.raises(ValueError, match="an offer takes"):
            transfers.transfer_candidates(jobs, ledgers, referenced, "d", bad)


def test_one_root_is_scanned_in_many_ranges(spark):
    n = 60_000
    keys = spark.range(n).select(F.lit("ready").alias("kind"), F.format_string("k%05d", (F.col("id") * 7919) % n).alias("job_key"), F.when(F.col("id") % 3 > 0, "root/a").otherwise("root").alias("placement"))
    odd = spark.createDataFrame([("failed", "x", "z"), ("ready", "x", None), ("ready", "x", "root.b"), ("ready", "x", "root.b"), (None, None, None)], "kind string, job_key string, placement string")
    ordered = scan_order(keys.unionByName(odd))
    rows = [tuple(r) for r in ordered.orderBy("place").collect()]
    assert [r[3] for r in rows] == list(range(1, n + 6))
    key = lambda r: ((r[0] is not None, r[0] or ""), (r[2] is not None, (r[2] or "").split("/")), (r[1] is not None, r[1] or ""))
    assert [r[:3] for r in rows] == sorted((r[:3] for r in rows), key=key)
    assert scan_order(odd.limit(0)).count() == 0
    # A range of four holds about a quarter of the rows, though nearly all are of one root.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r.n for r in keys.orderBy("kind", F.split("placement", "/"), "job_key").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n / 2


def test_markers_without_a_frame_are_dealt_out(spark):
    from stateloom.operators.joins import with_frames

    markers = spark.range(2000).selectExpr("id AS job_id", "concat('o--', id) AS job_key", "CASE WHEN id % 10 = 0 THEN concat('w', id) ELSE 'init' END AS record_ref").repartition(3)
    frames = spark.range(0, 2000, 20).selectExpr("concat('w', id) AS record_ref", "id AS f").unionByName(spark.createDataFrame([("init", -1)], "record_ref string, f long"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        rows = with_frames(markers, frames).selectExpr("*", "spark_partition_id() AS part").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r.job_id, r.f) for r in rows} == {(i, i if i % 20 == 0 else None) for i in range(2000)} and len(rows) == 2000
    parts = [r.part for r in rows if r.record_ref == "init"]
    assert max(parts.count(p) for p in set(parts)) < len(parts) / 2


def test_structure_texts_are_dealt_to_all_cores(spark):
    from stateloom import queries

    rows = queries.queries()["structure_rewrites"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert str(rows._jdf.queryExecution().optimizedPlan().toString()).count("number_texts(") <= 3
