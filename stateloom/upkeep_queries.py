"""Queries of upkeep, commits, children and structure texts, with their SQL."""

from __future__ import annotations

import bz2

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from .operators import merkle, structures, upkeep
from .plans import old_trees, states
from .queries import query
from .sources import members

# --- scans and commits -----------------------------------------------------------------------


@query(
    "fx_job",
    sql="""SELECT kind, placement, job_key, row_number() OVER (ORDER BY kind, string_split(placement, '/'), job_key) AS place
FROM (SELECT kind, job_key, CASE WHEN job_id % 9 = 0 THEN replace(placement, '/c', '.c') ELSE placement END AS placement FROM fx_job)""",
)
def scan_order(jobs):
    placement = F.when(F.col("job_id") % 9 == 0, F.regexp_replace("placement", "/c", ".c")).otherwise(F.col("placement"))
    return upkeep.scan_order(jobs.select("kind", "job_key", placement.alias("placement")))


SCANNED = """, en AS (SELECT placement_root AS root, job_key AS position, job_id % 3 > 0 AS included FROM (SELECT split_part(placement, '/', 1) AS placement_root, * FROM fx_job)),
cu AS (SELECT root, max(position) AS after FROM en WHERE root IN ('r2', 'r3') AND position < 'o--5' GROUP BY root),
fr AS (SELECT en.*, cu.after FROM en LEFT JOIN cu USING (root) WHERE cu.after IS NULL OR position > cu.after),
wi AS (SELECT *, sum(included::INT) OVER (ORDER BY root < 'r2', root, position ROWS UNBOUNDED PRECEDING) AS taken FROM (SELECT * FROM fr ORDER BY root < 'r2', root, position LIMIT 400)),
se AS (SELECT * FROM wi WHERE taken < 200 OR (taken = 200 AND included))
"""


def _window(jobs):
    entries = jobs.select(F.substring_index("placement", "/", 1).alias("root"), F.col("job_key").alias("position"), (F.col("job_id") % 3 > 0).alias("included"))
    cursors = entries.where("root IN ('r2', 'r3') AND position < 'o--5'").groupBy("root").agg(F.max("position").alias("position"))
    return upkeep.bounded_scan(entries, cursors, "r2", 200, 400)


@query("fx_job", sql=SCANNED + "SELECT root, position FROM se WHERE included")
def bounded_scan(jobs):
    return _window(jobs)[0]


@query(
    "fx_job",
    sql=SCANNED + """, re AS (SELECT root, max(position) AS reached FROM se GROUP BY root), ed AS (SELECT root, max(position) AS last FROM fr GROUP BY root)
SELECT ed.root, coalesce(re.reached, cu.after) AS position FROM ed LEFT JOIN re USING (root) LEFT JOIN cu USING (root) WHERE (re.reached IS NULL OR re.reached < ed.last) AND coalesce(re.reached, cu.after) IS NOT NULL""",
)
def bounded_scan_cursors(jobs):
    return _window(jobs)[1]


OUTCOMES = """, oc AS (SELECT job_id, attempt_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE activation_id END AS activation_id, outcome_action AS action, generation AS published_at FROM fx_frame WHERE kind = 'committing'),
st AS (SELECT job_id, kind, activation_id, attempt_id FROM fx_frame QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) = 1),
co AS (SELECT o.job_id, o.attempt_id, o.activation_id, o.action, CASE WHEN s.job_id IS NULL THEN 'no such job' WHEN s.kind NOT IN ('running', 'committing') THEN 'job is not running'
  WHEN o.activation_id IS DISTINCT FROM s.activation_id THEN 'another activation' WHEN o.attempt_id IS DISTINCT FROM s.attempt_id THEN 'another attempt' WHEN o.action IS NULL THEN 'no action' END AS fault
  FROM (SELECT * FROM oc QUALIFY row_number() OVER (PARTITION BY job_id, attempt_id ORDER BY published_at) = 1) o LEFT JOIN (SELECT * FROM st WHERE job_id % 10 > 0) s ON s.job_id = o.job_id)
"""


def _committed(frames):
    published = frames.where("kind = 'committing'").select(
        "job_id", "attempt_id", F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("activation_id")).alias("activation_id"), F.col("outcome_action").alias("action"), F.col("generation").alias("published_at")
    )
    newest = frames.groupBy("job_id").agg(F.max_by(F.struct("kind", "activation_id", "attempt_id"), "generation").alias("s")).select("job_id", "s.*").where("job_id % 10 > 0")
    return upkeep.commit_outcomes(published.unionByName(published), newest)


@query("fx_frame", sql=OUTCOMES + "SELECT * FROM co")
def outcome_commit(frames):
    return _committed(frames)


SPAWNED = """, sw AS (SELECT DISTINCT job_id, 'k' || (event_id % 5) AS child_key, CASE WHEN job_id % 6 = 1 AND event_id % 5 = 2 THEN NULL WHEN job_id % 6 = 2 THEN 'same' ELSE 'l' || (event_id % 5) END AS label, md5('k' || (event_id % 5)) AS digest FROM fx_frame)
"""


def _spawned(frames):
    key = F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string"))
    lost = (F.col("job_id") % 6 == 1) & (F.col("event_id") % 5 == 2)
    label = F.when(lost, None).when(F.col("job_id") % 6 == 2, "same").otherwise(F.concat(F.lit("l"), (F.col("event_id") % 5).cast("string")))
    return frames.select("job_id", key.alias("child_key"), label.alias("label"), F.md5(key).alias("digest")).distinct()


@query(
    "fx_frame",
    sql=OUTCOMES + SPAWNED + """, cl AS (SELECT DISTINCT job_id FROM (SELECT job_id, label, count(*) AS n FROM sw GROUP BY ALL) WHERE n > 1 OR label IS NULL)
SELECT co.job_id, co.attempt_id, co.action AS outcome_action, s.digests AS child_digests, s.labels AS child_labels, CASE WHEN cl.job_id IS NOT NULL THEN 'child labels are missing or not unique' END AS fault
FROM co LEFT JOIN (SELECT job_id, string_agg(child_key || '=' || digest, ',' ORDER BY child_key) AS digests, string_agg(child_key || '=' || coalesce(label, '?'), ',' ORDER BY child_key) AS labels FROM sw GROUP BY job_id) s USING (job_id) LEFT JOIN cl USING (job_id)
WHERE co.fault IS NULL""",
)
def begin_commit(frames):
    begun = upkeep.begin_commits(_committed(frames), _spawned(frames))
    pairs = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?")))), ",")
    return begun.select("job_id", "attempt_id", "outcome_action", pairs("child_digests").alias("child_digests"), pairs("child_labels").alias("child_labels"), "fault")


@query(
    "fx_frame",
    sql=SPAWNED + """, sx AS (SELECT job_id, job_id || child_key AS child_key, job_id + ascii(child_key[2]) AS n, md5(job_id || child_key) AS digest FROM sw),
bu AS (SELECT child_key, 'outcome' AS place, CASE WHEN n % 7 = 0 THEN 'other' ELSE digest END AS found FROM sx WHERE n % 3 = 0
  UNION ALL SELECT child_key, 'target', CASE WHEN n % 5 = 0 THEN 'other' ELSE digest END FROM sx WHERE n % 4 > 0),
mk AS (SELECT child_key FROM sx WHERE n % 11 < 4)
SELECT sx.job_id, sx.child_key, CASE WHEN o.found IS NULL AND t.found IS NULL THEN 'missing' WHEN o.found <> sx.digest THEN 'changed' WHEN mk.child_key IS NOT NULL THEN 'registered'
  WHEN o.found = sx.digest THEN 'publish' WHEN t.found <> sx.digest THEN 'mismatch' ELSE 'register' END AS fate
FROM sx LEFT JOIN bu o ON o.child_key = sx.child_key AND o.place = 'outcome' LEFT JOIN bu t ON t.child_key = sx.child_key AND t.place = 'target' LEFT JOIN mk ON mk.child_key = sx.child_key""",
)
def register_children(frames):
    key = F.concat(F.col("job_id").cast("string"), F.col("child_key"))
    spawns = _spawned(frames).select("job_id", key.alias("child_key"), (F.col("job_id") + F.ascii(F.substring("child_key", 2, 1))).alias("n"), F.md5(key).alias("digest"))
    lies = lambda place, other: spawns.select("child_key", F.lit(place).alias("place"), F.when(F.col("n") % other == 0, "other").otherwise(F.col("digest")).alias("found"), "n")
    bundles = lies("outcome", 7).where("n % 3 = 0").unionByName(lies("target", 5).where("n % 4 > 0"))
    return upkeep.children_to_register(spawns, bundles, spawns.where("n % 11 < 4"))


@query(
    "fx_job",
    sql="""SELECT job_id, CASE WHEN job_id % 3 = 0 AND kind IN ('ready', 'waiting', 'paused') THEN 'paused' ELSE kind END AS next_kind, CASE WHEN job_id % 3 = 0 AND kind IN ('ready', 'waiting', 'paused') THEN 'operator_pause_deferred' ELSE 'r' END AS reason,
CASE WHEN job_id % 3 = 0 AND kind IN ('ready', 'waiting', 'paused') THEN 'op' || job_id % 4 END AS operator, CASE WHEN job_id % 6 = 0 AND kind IN ('ready', 'waiting', 'paused') THEN 'why' || job_id % 5 END AS operator_reason,
CASE WHEN job_id % 3 = 0 AND kind IN ('ready', 'waiting', 'paused') THEN 'q' || job_id END AS request_id,
CASE WHEN job_id % 3 = 0 AND kind NOT IN ('ready', 'waiting', 'paused', 'succeeded', 'failed', 'cancelled', 'cancelling') THEN 'q' || job_id END AS still_asked FROM fx_job""",
)
def deferred_pause(jobs):
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    key = F.col("job_id")
    asked = F.struct(text("op", key % 4).alias("operator"), F.when(key % 6 == 0, text("why", key % 5)).alias("reason"), text("q", key).alias("request_id"))
    moves = jobs.select("job_id", F.col("kind").alias("next_kind"), F.lit("r").alias("reason"), F.when(key % 3 == 0, asked).alias("pause_requested"))
    moved = upkeep.deferred_pause(moves)
    return moved.withColumn("still_asked", F.col("pause_requested.request_id")).drop("pause_requested")


@query(
    "fx_job",
    sql="""SELECT job_id AS attempt_id, job_key, CASE WHEN job_id % 4 = 0 THEN CASE WHEN job_id % 3 = 0 THEN 'reap' ELSE 'terminate' END ELSE 'orphaned' END AS act FROM fx_job
WHERE kind <> 'running' AND readable AND job_id % 5 > 0 AND (job_id % 7 = 0 OR owner_uid = 1001)""",
)
def orphan_sweep(jobs):
    job = F.col("job_id")
    local = jobs.select(job.alias("attempt_id"), "job_key", F.when(job % 7 > 0, F.col("owner_uid")).alias("owner_uid"), (job % 5 == 0).alias("cancelling"), (job % 4 == 0).alias("fenced"), (job % 3 == 0).alias("exited"))
    return upkeep.orphan_attempts(local, jobs.where("kind = 'running'").select(job.alias("attempt_id")), jobs.where("NOT readable").select("job_key"), 1001)


@query(
    "fx_record", "fx_marker", "fx_manager",
    sql="""SELECT DISTINCT writer, segment FROM (SELECT event_id % 40 AS writer, event_id // 100 AS segment FROM fx_record)
WHERE (writer, segment) NOT IN (SELECT (r.event_id % 40, r.event_id // 100) FROM fx_marker m JOIN fx_record r ON r.record_ref = m.record_ref)
AND writer NOT IN (SELECT manager_id % 40 FROM fx_manager WHERE heartbeat_age_seconds <= 100 AND manager_id % 2 = 0)""",
)
def free_segments(records, markers, managers):
    placed = records.select("record_ref", (F.col("event_id") % 40).alias("writer"), F.floor(F.col("event_id") / 100).alias("segment"))
    referred = placed.join(markers.select("record_ref"), "record_ref", "left_semi").select("writer", "segment")
    writers = managers.where("manager_id % 2 = 0").select((F.col("manager_id") % 40).alias("writer"), "heartbeat_age_seconds")
    return upkeep.free_segments(placed.select("writer", "segment").distinct(), referred, writers, 100)


@query(
    "fx_child", "fx_job",
    sql="""SELECT DISTINCT c.child_id AS job_id, c.parent_id, j.kind AS parent_kind, j.attempts AS parent_generation, s.kind AS observed_kind FROM (SELECT DISTINCT child_id, parent_id FROM fx_child) c
JOIN fx_job j ON j.job_id = c.parent_id AND c.child_id % 9 > 0 JOIN (SELECT parent_id, child_id, min(kind) AS kind FROM fx_child WHERE line % 2 = 0 GROUP BY ALL) s ON s.parent_id = c.parent_id AND s.child_id = c.child_id""",
)
def decided_joins(children, jobs):
    named = children.select(F.col("child_id").alias("job_id"), "parent_id").distinct()
    named = named.withColumn("parent_key", F.when(F.col("job_id") % 9 > 0, F.concat(F.lit("o--"), F.col("parent_id").cast("string"))).otherwise("none"))
    parents = jobs.select(F.col("job_id").alias("parent_id"), F.col("job_key").alias("parent_key"), "kind", F.col("attempts").alias("generation"))
    seen = children.where("line % 2 = 0").groupBy("parent_id", F.col("child_id").alias("job_id")).agg(F.min("kind").alias("observed_kind"))
    return upkeep.decided_joins(named, parents, seen)


@query(
    "fx_child",
    sql="""SELECT DISTINCT parent_id AS job_id, 'i' || line AS name, CASE line % 5 WHEN 1 THEN 'invalid destination ../x' WHEN 2 THEN 'missing its staged destination d/m' END AS problem FROM fx_child WHERE line % 3 > 0 AND line % 5 IN (1, 2)""",
)
def input_problems(children):
    line = F.col("line")
    path = F.when(line % 5 == 1, "../x").when(line % 5 == 2, "d/m").when(line % 5 == 3, "d/here")
    declared = children.select(F.col("parent_id").alias("job_id"), F.concat(F.lit("i"), line.cast("string")).alias("name"), (line % 3 > 0).alias("required"), path.alias("destination")).distinct()
    return upkeep.input_problems(declared, children.select(F.col("parent_id").alias("job_id"), F.lit("d/here").alias("path")))


@query(
    "fx_child",
    sql=""", c AS (SELECT parent_id, line, min(kind) AS kind FROM fx_child GROUP BY ALL)
SELECT parent_id, count(*) AS n, count(*) FILTER (WHERE kind = 'succeeded') AS succeeded, count(*) FILTER (WHERE kind IN ('failed', 'cancelled')) AS failed, coalesce(string_agg('l' || line, ',' ORDER BY line) FILTER (WHERE line <> 2), '') AS labels FROM c GROUP BY parent_id""",
)
def children_view(children):
    one = children.groupBy("parent_id", F.col("line").alias("position")).agg(F.min("kind").alias("kind"), F.min("child_id").alias("job_id"))
    view = upkeep.children_view(one.withColumn("label", F.when(F.col("position") != 2, F.concat(F.lit("l"), F.col("position").cast("string")))))
    size = lambda c: F.size(c).cast("long").alias("n" if c == "all" else c)
    return view.select("parent_id", size("all"), size("succeeded"), size("failed"), F.array_join("labels", ",").alias("labels"))


@query(
    "fx_file", "fx_job",
    sql=""", p AS (SELECT j.placement || '/' || f.name AS path, CASE WHEN f.job_id % 6 > 0 THEN CAST(f.size_bytes AS BIGINT) END AS length FROM fx_file f JOIN fx_job j USING (job_id)),
t AS (SELECT '' AS tree, length FROM p UNION ALL SELECT split_part(path, '/', 1), length FROM p UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), length FROM p)
SELECT tree, count(*) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM t GROUP BY tree""",
)
def tree_bytes(files, jobs):
    named = files.join(jobs.select("job_id", "placement"), "job_id")
    size = F.when(F.col("job_id") % 6 > 0, F.rint("size_bytes").cast("long"))
    return upkeep.tree_bytes(named.select(F.concat_ws("/", "placement", "name").alias("path"), size.alias("length")), 2)


@query(
    "fx_file",
    sql=""", d AS (SELECT DISTINCT job_id AS run_id, port, pattern, ordinal, kind, optional FROM fx_file, (VALUES ('a', 'f1-*', 0, 'file', false), ('b', 'f?-*', 0, 'array', true), ('c', 'f9-*', 0, 'file', false), ('c', 'f3-*', 1, 'file', false), ('d', 'f7-*', 0, 'file', true)) v(port, pattern, ordinal, kind, optional)),
m AS (SELECT d.*, f.name FROM d LEFT JOIN fx_file f ON f.job_id = d.run_id AND f.name GLOB d.pattern)
SELECT run_id, port, coalesce(CASE WHEN kind = 'array' THEN string_agg(name, ',' ORDER BY ordinal, name) ELSE arg_min(name, (ordinal, name)) END, '') AS paths, CASE WHEN kind <> 'array' AND count(name) = 0 AND NOT optional THEN 'matched nothing' END AS fault FROM m GROUP BY run_id, port, kind, optional""",
)
def globbed_outputs(files):
    rules = F.array(*[F.struct(F.lit(p).alias("port"), F.lit(g).alias("pattern"), F.lit(o).alias("ordinal"), F.lit(k).alias("kind"), F.lit(q).alias("optional")) for p, g, o, k, q in (
        ("a", "f1-*", 0, "file", False), ("b", "f?-*", 0, "array", True), ("c", "f9-*", 0, "file", False), ("c", "f3-*", 1, "file", False), ("d", "f7-*", 0, "file", True)
    )])
    runs = files.select(F.col("job_id").alias("run_id")).distinct()
    found = upkeep.globbed_outputs(runs, files.select(F.col("job_id").alias("run_id"), F.col("name").alias("path")), rules)
    return found.select("run_id", "port", F.array_join("paths", ",").alias("paths"), "fault")


@query(
    "fx_edge",
    sql=""", e AS (SELECT *, (parent + child) % 6 = 0 AS barrier FROM fx_edge), f AS (SELECT DISTINCT parent AS node, CASE parent % 3 WHEN 0 THEN 'replace' WHEN 1 THEN 'detour' ELSE 'addition' END AS change FROM fx_edge WHERE parent % 10 = 1)
SELECT DISTINCT parent, child, barrier FROM (SELECT parent, child, barrier FROM e UNION ALL SELECT 100000 + f.node AS parent, e.child, true FROM f JOIN e ON e.parent = f.node WHERE e.barrier OR f.change <> 'addition')""",
)
def extended_barriers(edges):
    node = F.col("node")
    finished = edges.select(F.col("parent").alias("node")).where("node % 10 = 1").distinct()
    finished = finished.withColumn("change", F.when(node % 3 == 0, "replace").when(node % 3 == 1, "detour").otherwise("addition"))
    return upkeep.extended_barriers(edges.withColumn("barrier", (F.col("parent") + F.col("child")) % 6 == 0), finished, finished.select("node", (node + 100000).alias("new")))


OLD = """, nm AS (SELECT job_id, CASE job_id % 7 WHEN 5 THEN 'x/ht.task.s.t.u.0.o.3.finished/in/' ELSE 'x/' END || 'ht.task.s' || (job_id % 4) || '.t' || job_id || '.run.' || (job_id % 3) || '.unclaimed.' || (job_id % 6) || '.' || CASE WHEN job_id % 5 = 0 THEN 'running' WHEN job_id % 11 = 0 THEN 'odd' ELSE 'finished' END AS path FROM fx_job),
ot AS (SELECT path, 's' || (job_id % 4) AS taskset, 't' || job_id AS task_id, 'run' AS step, CAST(job_id % 3 AS VARCHAR) AS restarts, 'unclaimed' AS owner, CAST(job_id % 6 AS VARCHAR) AS priority, CASE WHEN job_id % 5 = 0 THEN 'running' ELSE 'finished' END AS status, job_id
  FROM nm WHERE job_id % 7 <> 5 AND job_id % 6 > 0 AND (job_id % 5 = 0 OR job_id % 11 > 0))
"""


def _old(jobs):
    job, text = F.col("job_id"), lambda c: c.cast("string")
    status = F.when(job % 5 == 0, "running").when(job % 11 == 0, "odd").otherwise("finished")
    name = F.concat(F.lit("ht.task.s"), text(job % 4), F.lit(".t"), text(job), F.lit(".run."), text(job % 3), F.lit(".unclaimed."), text(job % 6), F.lit("."), status)
    return jobs.select("job_id", "created_at", F.concat(F.when(job % 7 == 5, "x/ht.task.s.t.u.0.o.3.finished/in/").otherwise("x/"), name).alias("path"))


@query("fx_job", sql=OLD + "SELECT * EXCLUDE (job_id) FROM ot")
def old_tasks(jobs):
    return upkeep.old_tasks(_old(jobs).select("path"))


@query(
    "fx_job",
    sql=OLD + """SELECT path, taskset, task_id, 'ht.run.2024-03-0' || (1 + job_id % 8) || '_10.20.30' AS run, CAST('2024-03-0' || (1 + job_id % 8) || ' 10:20:30' AS TIMESTAMP) AS computed_at FROM ot WHERE status = 'finished' AND job_id % 4 > 0""",
)
def finished_tasks(jobs):
    folders = _old(jobs)
    name = lambda day: F.concat(F.lit("ht.run.2024-03-0"), day.cast("string"), F.lit("_10.20.30"))
    runs = folders.select("path", "job_id", F.explode(F.array(name(1 + F.col("job_id") % 8), F.lit("ht.run.2023-01-31_23.59.59"), F.lit("ht.run.current"))).alias("run"))
    runs = runs.where("job_id % 4 > 0 OR run = 'ht.run.current'")
    return upkeep.finished_tasks(upkeep.old_tasks(folders.select("path")), runs.select("path", "run"))


@query("fx_job", sql=OLD + "SELECT status, count(*) AS n FROM ot WHERE status <> 'finished' GROUP BY status")
def unfinished_by_status(jobs):
    return upkeep.unfinished_tasks(upkeep.old_tasks(_old(jobs).select("path")))


OLD_MEMBERS = """, me AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN '/data' || chr(10) || 'a ' || job_id || chr(10) || 'signature' || chr(10) || 'key' || chr(10) WHEN job_id % 3 = 1 THEN 'one line ' || job_id END AS manifest,
  'ht.run.2024-03-0' || (1 + job_id % 8) || '_10.20.30' AS run FROM ot WHERE status = 'finished' AND job_id % 4 > 0),
ft AS (SELECT path, taskset, task_id, run, CASE WHEN job_id % 8 = 1 THEN 'unknown' WHEN job_id % 2 = 0 THEN 'steps' ELSE 'relax' END AS code, CASE WHEN job_id % 8 = 1 THEN '0' ELSE '1.' || job_id END AS version,
  CASE WHEN job_id % 5 < 3 THEN 'Task ' || job_id END AS description, CASE WHEN job_id % 17 > 0 THEN sha256(CASE WHEN job_id % 3 = 0 THEN '/data' || chr(10) || 'a ' || job_id || chr(10) ELSE manifest END) END AS manifest_hash FROM me)
"""


@pandas_udf(BinaryType())
def _packed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bz2.compress(t.encode()), na_action="ignore")


def _old_tree(jobs):
    """(tasks, runs, members): programs, settings and packed manifests, some cut off."""
    folders = _old(jobs)
    name = lambda day: F.concat(F.lit("ht.run.2024-03-0"), day.cast("string"), F.lit("_10.20.30"))
    job, text = F.col("job_id"), F.col("job_id").cast("string")
    runs = folders.select("path", "job_id", F.explode(F.array(name(1 + job % 8), F.lit("ht.run.2023-01-31_23.59.59"), F.lit("ht.run.current"))).alias("run"))
    runs = runs.where("job_id % 4 > 0 OR run = 'ht.run.current'")
    program = lambda code: F.concat(F.lit(f"#!/bin/sh\n# {code}\n# 1."), text, F.lit("\nexit\n")).cast("binary")
    manifest = F.when(job % 3 == 0, F.concat(F.lit("/data\na "), text, F.lit("\nsignature\nkey\n"))).when(job % 3 == 1, F.concat(F.lit("one line "), text))
    packed = F.when(job % 17 == 0, F.substring(F.col("m"), 1, 20)).otherwise(F.col("m"))
    config = F.concat(F.lit("[other]\ndescription = no\n[main]\nx: 1\n"), F.when(job % 5 < 3, F.concat(F.lit("Description : Task "), text)).otherwise(""), F.lit("\n[more]\ndescription=no\n"))
    made = folders.select("path", "job_id", _packed(manifest).alias("m"))
    members = made.select("path", F.lit("ht_run").alias("name"), F.when(job % 8 == 1, F.lit("x").cast("binary")).otherwise(program("relax")).alias("content"))
    members = members.unionByName(made.where("job_id % 2 = 0").select("path", F.lit("ht_steps").alias("name"), program("steps").alias("content")))
    members = members.unionByName(made.select("path", F.lit("ht.config").alias("name"), config.cast("binary").alias("content")))
    members = members.unionByName(made.where("m IS NOT NULL").select("path", F.lit("ht.manifest.bz2").alias("name"), packed.alias("content")))
    return upkeep.old_tasks(folders.select("path")), runs.select("path", "run"), members


@query(
    "fx_job",
    sql=OLD + OLD_MEMBERS + """SELECT *, 'v1:' || coalesce(manifest_hash, sha256('/old/' || path || '/' || run)) AS immutable_id, manifest_hash IS NOT NULL AS identity_stable,
CASE WHEN code = 'unknown' OR taskset = 's3' THEN NULL ELSE '{"code":"' || code || '","n":' || length(task_id) || '}' END AS outputs,
CASE WHEN code = 'unknown' THEN path || ': no code' WHEN taskset = 's3' THEN path || ': an extractor returns a mapping of output roles' END AS degraded FROM ft""",
)
def collect_finished_tree(jobs):
    def extract(task):
        if task["code"] == "unknown":
            raise ValueError("no code")
        return None if task["taskset"] == "s3" else {"n": len(task["task_id"]), "code": task["code"]}

    described = old_trees.described_tasks(*_old_tree(jobs), root="/old")
    return old_trees.collect_finished_tree(described.drop("computed_at"), extract)


@query(
    "fx_job",
    sql=OLD + """SELECT status, count(*) AS n FROM ot WHERE status <> 'finished' GROUP BY status
UNION ALL SELECT 'no_run', count(*) FROM ot WHERE status = 'finished' AND job_id % 4 = 0 HAVING count(*) > 0""",
)
def old_tree_counts(jobs):
    tasks, runs, _ = _old_tree(jobs)
    return old_trees.tree_counts(tasks, runs)


@query(
    "documents",
    sql="""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text <> ''),
n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM l)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - strlen(line) - 1 AS BIGINT) AS "offset", sha256(line) AS line_sha256
FROM n WHERE line_no < last OR line <> ''""",
)
def member_lines(documents):
    """Texts packed in three ways, and read again line by line."""

    def packed(key: int | None, text: str) -> bytes:
        return members.packed(text.encode(), ("", *members.SUFFIXES)[(key or 0) % 4])

    lines = members.member_lines(documents, ["doc_id"], "text", opened=packed)
    return lines.select("doc_id", "line_no", "offset", F.sha2("line", 256).alias("line_sha256"))


# --- trees of files --------------------------------------------------------------------------


def _placed_files(files, jobs):
    """(job_id, tree, path, name, size) of files below placement and job, one tree a region; a file may repeat.  Rows lie by job, whose key a path holds."""
    place = F.split("placement", "/")
    path = F.concat_ws("/", F.slice(place, 2, 8), F.col("job_key"), F.when(F.col("job_id") % 3 == 0, "tmp").otherwise("out"), F.concat_ws("-", "name", F.col("size").cast("string")))
    sized = files.select("job_id", "name", F.floor("size_bytes").cast("long").alias("size"))
    return sized.join(jobs.select("job_id", "placement", "job_key"), "job_id").select("job_id", place[0].alias("tree"), path.alias("path"), "name", "size")


def _entries(placed, *more):
    """Files as entries of trees; some are links, some excluded."""
    link = F.col("job_id") % 7 == 0
    return placed.select(
        "tree", "path", F.when(link, "symlink").otherwise("file").alias("type"),
        F.when(~link, F.col("size")).alias("size"), F.when(~link, F.sha2("name", 256)).alias("sha256"), F.when(link, F.col("name")).alias("target"), *more,
    )


#: Each level folded into buckets and these into folders, five levels up.
_LEVELS = """, fi AS (SELECT DISTINCT split_part(placement, '/', 1) AS tree, array_to_string(string_split(placement, '/')[2:], '/') || '/' || job_key || CASE WHEN job_id % 3 = 0 THEN '/tmp/' ELSE '/out/' END || name || '-' || CAST(floor(size_bytes) AS BIGINT) AS path,
  job_id % 7 = 0 AS link, CAST(floor(size_bytes) AS BIGINT) AS size, name FROM fx_file JOIN (SELECT job_id, placement, job_key FROM fx_job) USING (job_id) WHERE NOT (job_id % 3 = 0 AND job_key LIKE '%5')),
d0 AS (SELECT tree, path, CASE WHEN link THEN 'symlink' ELSE 'file' END AS kind, CASE WHEN link THEN sha256('symlink|' || name) ELSE sha256('file|' || size || '|' || sha256(name)) END AS digest, 1::BIGINT AS n_files, CASE WHEN link THEN 0 ELSE size END AS bytes FROM fi)""" + "".join(
    f"""
, b{k} AS (SELECT tree, array_to_string(string_split(path, '/')[:-2], '/') AS parent, substr(sha256(string_split(path, '/')[-1]), 1, 3) AS bucket, sum(n_files)::BIGINT AS n_files, sum(bytes)::BIGINT AS bytes,
  sha256(string_agg(string_split(path, '/')[-1] || '|' || kind || '|' || digest, chr(10) ORDER BY string_split(path, '/')[-1] || '|' || kind || '|' || digest)) AS part FROM d{k} GROUP BY ALL),
d{k + 1} AS (SELECT tree, parent AS path, 'directory' AS kind, sha256(string_agg(bucket || '|' || part, chr(10) ORDER BY bucket)) AS digest, sum(n_files)::BIGINT AS n_files, sum(bytes)::BIGINT AS bytes FROM b{k} GROUP BY tree, parent)"""
    for k in range(5)
)


@query("fx_file", "fx_job", sql=_LEVELS + " " + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(6)))
def folder_digests(files, jobs):
    # Doubles are of one job: they are found where the join has put it.
    return merkle.tree_digests(_entries(_placed_files(files, jobs).distinct()), exclude=["*5/tmp"])


@query(
    "fx_file", "fx_job",
    sql=_LEVELS + """, up AS (SELECT tree, path, unnest(range(0, len(string_split(path, '/')) + 1)) AS k FROM d0 WHERE ends_with(path, '17'))
SELECT DISTINCT tree, array_to_string(string_split(path, '/')[:k], '/') AS path, 'changed' AS change FROM up""",
)
def changed_folders(files, jobs):
    """Paths that differ once the files whose path ends in 17 have another size or target."""
    both = _entries(_placed_files(files, jobs), "job_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("new"))
    touched = F.col("new") & F.col("path").endswith("17")
    after = {"size": F.when(touched, F.col("size") + 1).otherwise(F.col("size")), "target": F.when(touched, F.concat("target", F.lit("x"))).otherwise(F.col("target"))}
    return merkle.changed_entries(both.withColumns(after), exclude=["*5/tmp"], beside=["job_id"])


# --- structure texts -------------------------------------------------------------------------


def _structures(parts):
    """Cells whose third vector may point down, whose comment may name moments, and some that are malformed."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    comment = F.concat(F.lit("cell"), F.when(key % 5 == 0, " [MAGMOM=3*1.5]").otherwise(""))
    down = F.when(key % 2 == 0, "-").otherwise("")
    text = F.concat(
        comment, F.lit("\n "), F.when(key % 13 == 0, "x").otherwise(F.lit("1.5")), F.lit(" \n"), size, F.lit(".25 0 0\n0 2 0.0\n0 0 "), down, F.lit("3"),
        F.when(key % 17 == 0, "\n").otherwise(F.concat(F.lit("\nSi O\n"), size, F.when(key % 11 == 0, "").otherwise(" 4"), F.lit("\nDirect\n"))),
    )
    # The table is small and its texts are costly to read: one file's rows are dealt to all cores.
    dealt = parts.select("p_partkey", "p_size").repartition(parts.sparkSession.sparkContext.defaultParallelism)
    return dealt.select("p_partkey", "p_size", text.alias("text"))


FAULTY = "CASE WHEN p_partkey % 17 = 0 THEN 'fewer than seven header lines' WHEN p_partkey % 13 = 0 THEN 'invalid scale, lattice or count line' WHEN p_partkey % 11 = 0 THEN 'species and counts do not match' END"


@query(
    "part",
    sql=f"""SELECT p_partkey, fault, CASE WHEN fault IS NULL THEN CASE WHEN p_partkey % 5 = 0 THEN '3*1.5' ELSE p_size || '*5 4*5' END END AS moments, CASE WHEN fault IS NULL THEN p_size + 0.25e0 END AS first
FROM (SELECT *, {FAULTY} AS fault FROM part)""",
)
def structure_header(parts):
    read = _structures(parts).withColumn("h", structures.header(F.col("text")))
    good = F.col("h.fault").isNull()
    return read.select("p_partkey", F.col("h.fault").alias("fault"), F.when(good, structures.moments(F.col("h"))).alias("moments"), F.when(good, F.col("h.lattice")[0][0]).alias("first"))


@query(
    "part",
    sql=f"""SELECT p_partkey, CASE WHEN p_partkey % 13 > 0 THEN '3' END AS scale,
CASE WHEN {FAULTY} IS NULL THEN CASE WHEN p_partkey % 2 = 0 THEN '-' || p_size || '.25 0 0|0 -2 0|0 0 3' ELSE p_size || '.25 0 0|0 2 0.0|0 0 3' END END AS lattice FROM part""",
)
def structure_rewrites(parts):
    text = F.col("text")
    line = lambda t, i: F.get(F.split(t, "\n"), F.lit(i))
    written = _structures(parts).select("p_partkey", structures.scaled_lattice(text, 2.0).alias("scaled"), structures.right_handed(text).alias("right"))
    rows = F.array(*[F.regexp_replace(line(F.col("right"), i), r"-0(?= |$)", "0") for i in (2, 3, 4)])
    return written.select("p_partkey", line(F.col("scaled"), 1).alias("scale"), F.when(F.col("right").isNotNull(), F.array_join(rows, "|")).alias("lattice"))


@query(
    "part",
    sql="""SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'incomplete_outcar' END, CASE WHEN p_partkey % 7 > 0 AND p_size >= 30 THEN 'electronic_nonconvergence' END,
CASE WHEN p_partkey % 7 > 0 AND p_partkey % 4 IN (2, 3) THEN 'ionic_nonconvergence' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 5 = 0 THEN 'positive_final_energy' END) AS codes,
CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 10 END AS waves FROM part""",
)
def final_diagnostics(parts):
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    output = F.concat(
        F.lit("   NELM   = 30; \n NSW    =  "), text(key % 4), F.lit("\n"),
        F.when(key % 2 == 0, F.concat(F.lit(" maximum number of plane-waves:   "), text(key * 10), F.lit("\n maximum number of plane-waves: 5\n"))).otherwise(""),
        F.when(key % 3 > 0, " General timing and accounting informations for this job:").otherwise(""),
    )
    energy = F.when(key % 5 == 0, "1.5E+01").otherwise("-.2E+01")
    steps = F.concat(F.lit("DAV:  50  x\n   1 F= -.1E+01 E0\n   2 F= 9.0 E0\nRMM:  "), text(F.col("p_size")), F.lit("  y\n   3 F= "), energy, F.lit(" E0"))
    files = parts.select("p_partkey", output.alias("output"), F.when(key % 7 > 0, steps).alias("steps"))
    found = structures.final_diagnostics(files, "p_partkey").select("p_partkey", F.array_join("codes", ",").alias("codes"))
    return found.join(files.select("p_partkey", structures.plane_waves(F.col("output")).alias("waves")), "p_partkey")


@query(
    "part",
    sql="SELECT p_partkey, 'n=' || p_name || ' ' || p_partkey || '$x' AS rendered, CASE WHEN p_partkey % 3 > 0 THEN 'code' || p_size ELSE 'unknown' END AS name, CASE WHEN p_partkey % 3 > 0 THEN '1.' || p_partkey ELSE '0' END AS version FROM part",
)
def templates_and_programs(parts):
    key = F.col("p_partkey").cast("string")
    program = F.concat(F.lit("#!/bin/sh\n"), F.when(F.col("p_partkey") % 3 > 0, "# code").otherwise("code"), F.col("p_size").cast("string"), F.lit("\n#  1."), key, F.lit(" \n"))
    found = structures.program_of(program)
    made = structures.rendered(F.lit("n=$name ${key}$$x"), {"name": F.col("p_name"), "key": key})
    return parts.select("p_partkey", made.alias("rendered"), found["name"].alias("name"), found["version"].alias("version"))


@query(
    "fx_job",
    sql="""SELECT job_id, 'site.a' AS module, 'site-a' AS distribution, '2' AS version FROM fx_job WHERE runner = 'pkg:site.a' AND job_id % 8 = 0
UNION ALL SELECT job_id, 'site.ab.c', 'site', '1' FROM fx_job WHERE runner = 'pkg:site.a' AND job_id % 8 > 0 UNION ALL SELECT job_id, 'other', NULL, NULL FROM fx_job WHERE runner = 'installed'""",
)
def runner_provenance(jobs):
    packages = jobs.sparkSession.createDataFrame([("site", "site", "1"), ("site.a", "site-a", "2"), ("oth", "oth", "9")], "package string, distribution string, version string")
    runner = F.when(F.col("runner") == "installed", "pkg:other").when((F.col("runner") != "") & (F.col("job_id") % 8 > 0), "pkg:site.ab.c").otherwise(F.col("runner"))
    return states.runner_provenance(jobs.select("job_id", runner.alias("runner")), packages)
