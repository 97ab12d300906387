"""Queries of children, campaigns, outputs, prechecks and clocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scalars import timestamp_seconds
from .operators import dataflow, joins
from .plans import outputs, reports
from .queries import query
from .sources import records
from .streaming import clocks

UUIDS = """, ch AS (SELECT job_id, generation, event_id, is_error, event_id % 4 AS n, event_id % 7 AS c FROM fx_frame),
id AS (SELECT *, '00000000-0000-4000-8000-00000000000' || c AS child FROM ch),
nm AS (SELECT job_id, generation, 0 AS source, 0 AS spot, CASE WHEN n = 3 THEN '' ELSE 'l' || n END AS label, child AS child_id, 'tag--' || child AS child_key, NULL AS kind FROM id WHERE event_id % 3 = 0 AND NOT is_error
  UNION ALL SELECT job_id, generation, 1, spot, CASE WHEN n = 0 AND spot = 1 THEN NULL ELSE 'l' || ((n + spot) % 3) END, child, 'k' || child, CASE WHEN event_id % 2 = 0 THEN 'running' END FROM id, (VALUES (0), (1)) x(spot) WHERE event_id % 3 = 1 AND NOT is_error
  UNION ALL SELECT job_id, generation, 2, 0, 'l' || n, child, NULL, 'succeeded' FROM id WHERE event_id % 3 = 1 AND NOT is_error),
ru AS (SELECT *, sum(begins) OVER (PARTITION BY job_id, label ORDER BY generation, source, spot) AS run FROM
  (SELECT *, CASE WHEN lag(child_id) OVER (PARTITION BY job_id, label ORDER BY generation, source, spot) = child_id THEN 0 ELSE 1 END AS begins FROM nm WHERE label <> '')),
la AS (SELECT *, max(run) OVER (PARTITION BY job_id, label) AS newest FROM ru)
"""


@query(
    "fx_frame",
    sql=UUIDS + """SELECT job_id, label, max(child_id) AS child_id, max(child_key) FILTER (WHERE begins = 1) AS child_key, arg_max(kind, (generation, source, spot)) FILTER (WHERE kind IS NOT NULL) AS kind
FROM la WHERE run = newest GROUP BY job_id, label""",
)
def children_of(frames):
    """Children from labels, joins and summaries together."""
    n, at = F.col("event_id") % 4, F.col("event_id") % 3
    child = F.concat(F.lit("00000000-0000-4000-8000-00000000000"), (F.col("event_id") % 7).cast("string"))
    text = lambda c: F.concat(F.lit("l"), c.cast("string"))
    item = lambda label, key, kind: F.struct(label.alias("label"), child.alias("job_id"), key.alias("job_key"), kind.alias("kind"))
    running = F.when(F.col("event_id") % 2 == 0, "running")
    seen = [item(F.when((n == 0) & F.lit(k == 1), None).otherwise(text((n + k) % 3)), F.concat(F.lit("k"), child), running) for k in (0, 1)]
    rows = frames.select(
        "job_id", "generation", "is_error",
        F.when(at == 0, F.create_map(F.concat(F.lit("tag--"), child), F.when(n == 3, "").otherwise(text(n)))).alias("child_labels"),
        F.when(at == 1, F.array(*seen)).alias("join_children"),
        F.when(at == 1, F.array(item(text(n), F.lit(None).cast("string"), F.lit("succeeded")))).alias("join_summary"),
    )
    return joins.children_of(rows).drop("first_position")


@query(
    "fx_job",
    sql="""SELECT job_id, 'shared' || CASE WHEN job_id % 3 = 0 THEN ',x' || job_id ELSE ',b' END AS inputs, CASE WHEN job_id % 4 = 0 THEN 'POSCAR=own' ELSE 'POSCAR=all' END AS files, CASE WHEN job_id % 5 = 0 THEN '' ELSE 'k=1' END AS parameters,
CASE WHEN job_id % 6 = 0 THEN NULL WHEN job_id % 6 = 1 THEN 't' || job_id ELSE 'campaign' END AS tag, placement, CASE WHEN job_id % 2 = 0 THEN priority ELSE 500 END AS priority FROM fx_job""",
)
def merged_jobs(jobs):
    """A campaign's items over its shared values."""
    key = F.col("job_id")
    text, none = key.cast("string"), F.create_map().cast("map<string,string>")
    items = jobs.select(
        "job_id", "placement", "priority",
        F.when(key % 3 == 0, F.create_map(F.lit("b"), F.concat(F.lit("x"), text))).otherwise(none).alias("inputs"),
        F.when(key % 4 == 0, F.create_map(F.lit("POSCAR"), F.lit("own"))).alias("files"),
        F.when(key % 5 == 0, F.create_map(F.lit("k"), F.lit(None).cast("string"))).alias("parameters"),
        F.when(key % 6 == 1, F.concat(F.lit("t"), text)).alias("tag"),
        F.concat(F.array(F.lit("placement")), F.when(key % 2 == 0, F.array(F.lit("priority"))).otherwise(F.array()), F.when(key % 6 < 2, F.array(F.lit("tag"))).otherwise(F.array())).alias("given"),
    )
    shared = {"inputs": {"a": "shared", "b": "b"}, "files": {"POSCAR": "all"}, "parameters": {"k": "1"}, "tag": "campaign", "placement": "none", "priority": 500}
    made = dataflow.merged_jobs(items, shared, "job_id")
    pair = F.array_join(F.transform(F.map_entries("files"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return made.select(
        "job_id", F.concat_ws(",", F.col("inputs")["a"], F.col("inputs")["b"]).alias("inputs"), pair.alias("files"),
        F.coalesce(F.concat(F.lit("k="), F.col("parameters")["k"]), F.lit("")).alias("parameters"), "tag", "placement", "priority",
    )


@query(
    "fx_job",
    sql="""SELECT job_id, partition, CASE partition WHEN 'p1' THEN 'the partition is remote' WHEN 'p3' THEN 'no such partition' END AS fault, CASE WHEN partition IN ('p0', 'p2') THEN '/data/' || partition END AS path, turn_partition
FROM (SELECT job_id, 'p' || (CAST('0x' || substr(sha256(job_key), 1, 16) AS UHUGEINT) % 4) AS partition, 'p' || (job_id % 4) AS turn_partition FROM fx_job)""",
)
def routed_batches(jobs):
    """Items of a batch by hash of their key, and in turn."""
    spark, names = jobs.sparkSession, ["p0", "p1", "p2", "p3"]
    partitions = spark.createDataFrame([("p0", False, "/data/p0"), ("p1", True, None), ("p2", False, "/data/p2")], "partition string, remote boolean, path string")
    hashed = dataflow.routed(jobs.select("job_id", "job_key"), "job_key", partitions, names)
    turns = dataflow.routed(jobs.select("job_id", F.col("job_id").alias("n")), "job_id", partitions, names, turn="n").select("job_id", F.col("partition").alias("turn_partition"))
    return hashed.drop("job_key").join(turns, "job_id")


@query(
    "fx_job",
    sql="""SELECT job_id, job_id % 3 = 0 AS claim, job_id % 5 = 1 AS language, job_id % 4 = 2 AS inputs, job_id % 6 = 5 AS step, job_id % 7 IN (1, 2) AS environment, job_id % 8 IN (3, 4) AS runner FROM fx_job""",
)
def precheck_flags(jobs):
    """The six problems that a precheck tells apart."""
    key = F.col("job_id")
    status = lambda bad: F.struct(F.when(bad, "problem").otherwise("ok").alias("status"))
    findings = jobs.select(
        "job_id",
        F.when(key % 2 == 0, status(key % 3 == 0)).otherwise(F.when(key % 3 == 0, status(F.lit(True)))).alias("claim"),
        F.when(key % 5 > 0, status(key % 5 == 1)).alias("language"),
        F.when(key % 4 == 2, F.array(F.lit("POSCAR"))).when(key % 4 == 1, F.array().cast("array<string>")).alias("inputs"),
        F.when(key % 6 == 5, "step").when(key % 6 == 4, "").alias("step"),
        F.array(F.struct(F.lit("A").alias("name"), F.when(key % 7 == 1, "unresolved").otherwise("set").alias("status"))).alias("environment"),
        F.when(key % 7 == 2, F.array(F.lit("B"))).alias("environment_problems"),
        F.when(key % 8 == 3, F.struct(F.lit(None).cast("string").alias("status"))).when(key % 8 > 3, F.struct(F.when(key % 8 == 4, "problem").otherwise("ok").alias("status"))).alias("runner"),
    )
    return reports.finding_flags(findings)


@query(
    "part",
    sql="""SELECT p_partkey AS job_id, 'structure' AS port, 'relaxed' AS role, 'file' AS kind, NULL AS value, CASE WHEN p_partkey % 5 > 0 THEN 'cwl/out/' || p_partkey END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'a file without a location' END AS fault FROM part WHERE p_partkey % 11 > 0
UNION ALL SELECT p_partkey, 'energy', CASE WHEN p_partkey % 3 > 0 THEN 'energy' END, 'data', CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || '"' ELSE '{"n":' || p_size || '}' END, NULL, CASE WHEN p_partkey % 3 = 0 THEN 'no role' END FROM part WHERE p_partkey % 11 > 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, 'the document is no object' FROM part WHERE p_partkey % 11 = 0""",
)
def document_outputs(parts):
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    place = F.when(key % 5 == 0, "").when(key % 5 < 3, F.concat(F.lit(', "path": "out/'), text, F.lit('"'))).otherwise(F.concat(F.lit(', "location": "file://out/'), text, F.lit('"')))
    data = F.when(key % 2 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))).otherwise(F.concat(F.lit('{"n": '), F.col("p_size").cast("string"), F.lit("}")))
    document = F.when(key % 11 == 0, "[1]").otherwise(F.concat(F.lit('{"structure": {"class": "File"'), place, F.lit('}, "energy": '), data, F.lit("}")))
    roles = parts.select(key.alias("job_id"), F.lit("structure").alias("port"), F.lit("relaxed").alias("role"))
    roles = roles.unionByName(parts.where("p_partkey % 3 > 0").select(key.alias("job_id"), F.lit("energy").alias("port"), F.lit("energy").alias("role")))
    return outputs.document_outputs(parts.select(key.alias("job_id"), document.alias("outputs")), roles, "cwl")


@query(
    "part",
    sql="""SELECT p_partkey AS job_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN NULL ELSE -p_size - 0.125e0 END AS total_energy,
CASE WHEN p_partkey % 3 = 0 THEN 'no final structure' WHEN p_partkey % 7 = 0 THEN 'cannot construct relaxed structure: fewer than seven header lines' WHEN p_partkey % 5 = 0 THEN 'cannot construct total energy' END AS error FROM part""",
)
def relaxed_outputs(parts):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    good = F.concat(F.lit("cell\n1.0\n"), size, F.lit(" 0 0\n0 2 0\n0 0 3\nSi\n2\nDirect\n"))
    structure = F.when(key % 3 == 0, None).when(key % 7 == 0, "cell\n1.0\n").otherwise(good)
    line = lambda value: F.concat(F.lit("  energy  without entropy=  -1.0  energy(sigma->0) =   "), value, F.lit("\n"))
    output = F.concat(line(F.lit("-99.5")), F.when(key % 5 == 0, line(F.lit("*****"))).otherwise(line(F.concat(F.lit("-"), size, F.lit(".125")))))
    made = outputs.relaxed_outputs(parts.select(key.alias("job_id"), structure.alias("structure"), output.alias("output")))
    return made.select("job_id", "total_energy", "error")


@query(
    "part",
    sql="""SELECT path, CAST(CASE WHEN path LIKE '%/POSCAR' THEN 0 WHEN path LIKE '%/POSCAR.%' THEN 1 ELSE 2 END AS INT) AS pattern FROM
(SELECT 'd/' || p_partkey || CASE p_partkey % 5 WHEN 0 THEN '/POSCAR' WHEN 1 THEN '/POSCAR.' || p_size WHEN 2 THEN '/s' || p_size || '.vasp' WHEN 3 THEN '/poscar' ELSE '/POSCAR2' END AS path FROM part) WHERE path NOT LIKE '%poscar' AND path NOT LIKE '%POSCAR2'""",
)
def structure_files(parts):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(key % 5 == 0, "/POSCAR").when(key % 5 == 1, F.concat(F.lit("/POSCAR."), size)).when(key % 5 == 2, F.concat(F.lit("/s"), size, F.lit(".vasp"))).when(key % 5 == 3, "/poscar").otherwise("/POSCAR2")
    return records.structure_files(parts.select(F.concat(F.lit("d/"), key.cast("string"), name).alias("path")))


@query("events", sql="SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS seconds FROM events")
def frame_seconds(events):
    return events.select("event_id", timestamp_seconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))).alias("seconds"))


#: Seconds of grace and of silence, and the moment up to which the clocks have run.
GRACE, SILENCE, UPTO = 86_400, 86_400, "2024-02-15 00:00:00"
OBSERVED = f"""WITH o AS (SELECT user_id AS job_id, ts AS "at", 'c' || (event_id % 2) AS child, event_type = 'signup' AS resolved FROM events WHERE ts <= TIMESTAMP '{UPTO}'),
q AS (SELECT job_id, "at", child, bool_or(resolved) AS resolved FROM o GROUP BY ALL),
b AS (SELECT *, last_value(CASE WHEN NOT resolved THEN child END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY "at", child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
k AS (SELECT *, resolved AND child = before AS stops FROM b WHERE NOT resolved OR child = before),
s AS (SELECT *, NOT resolved AND (before IS NULL OR before <> child OR coalesce(lag(stops) OVER (PARTITION BY job_id ORDER BY "at", child), false)) AS starts FROM k),
r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY job_id ORDER BY "at", child ROWS UNBOUNDED PRECEDING) AS run FROM s),
e AS (SELECT job_id, run, arg_min(child, ("at", child)) AS child, min("at") AS first_at, min("at") FILTER (WHERE stops) AS stopped FROM r WHERE run > 0 GROUP BY job_id, run),
n AS (SELECT *, lead(first_at) OVER (PARTITION BY job_id ORDER BY run) AS next_at, first_at + INTERVAL {GRACE} SECOND AS decided FROM e)
"""


@query("events", sql=OBSERVED + f"SELECT job_id, child, first_at AS first_unresolved_at, 'join_unresolvable' AS verdict, decided AS decided_at FROM n WHERE decided <= least(coalesce(stopped, TIMESTAMP '{UPTO}'), coalesce(next_at, TIMESTAMP '{UPTO}'), TIMESTAMP '{UPTO}')")
def join_grace(events):
    """Joins given up after the grace, in the clocks' batch form."""
    observed = events.select(F.col("user_id").alias("job_id"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("child"), (F.col("event_type") == "signup").alias("resolved"), F.col("ts").alias("at"))
    return clocks.join_grace_of(observed, GRACE, F.lit(UPTO).cast("timestamp_ntz"))


@query(
    "events",
    sql=f"""WITH l AS (SELECT DISTINCT 's' || user_id AS source, 'g' || (event_id % 3) AS generation, ts AS "at" FROM events WHERE ts <= TIMESTAMP '{UPTO}'),
n AS (SELECT *, lag("at") OVER w AS last_at, lag(generation) OVER w AS before, lead("at") OVER w AS next_at FROM l WINDOW w AS (PARTITION BY source ORDER BY "at", generation))
SELECT source, 'silent' AS verdict, "at" + INTERVAL {SILENCE} SECOND AS "at" FROM n WHERE coalesce(next_at, TIMESTAMP '{UPTO}') >= "at" + INTERVAL {SILENCE} SECOND
UNION ALL SELECT source, CASE WHEN "at" >= last_at + INTERVAL {SILENCE} SECOND THEN 'reopened' ELSE 'rotated' END, "at" FROM n WHERE "at" >= last_at + INTERVAL {SILENCE} SECOND OR generation <> before""",
)
def source_silence(events):
    """Sources that fall silent, speak again or are rotated, in the clocks' batch form."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    lines = events.select(text("s", F.col("user_id")).alias("source"), text("g", F.col("event_id") % 3).alias("generation"), F.col("ts").alias("at"))
    return clocks.source_silence_of(lines, SILENCE, F.lit(UPTO).cast("timestamp_ntz"))
