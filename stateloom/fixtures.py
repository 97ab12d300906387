"""Derived relations over the test tables: one SQL text for Spark and for the oracle.

A text names base tables in braces; ``view`` binds them to DataFrames, ``cte`` to names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_job": """
SELECT o.o_orderkey AS job_id,
       concat('o--', cast(o.o_orderkey AS string)) AS job_key,
       cast(substring(o.o_orderpriority, 1, 1) AS int) * 100 AS priority,
       CASE o.o_orderstatus
         WHEN 'F' THEN CASE o.o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' ELSE 'succeeded' END
         WHEN 'O' THEN CASE o.o_orderkey % 5 WHEN 0 THEN 'submitted' ELSE 'ready' END
         ELSE CASE o.o_orderkey % 8 WHEN 0 THEN 'waiting' WHEN 4 THEN 'waiting' WHEN 1 THEN 'running' WHEN 5 THEN 'running' WHEN 3 THEN 'committing' WHEN 7 THEN 'cancelling' ELSE 'paused' END
       END AS kind,
       concat('r', cast(n.n_regionkey AS string), '/n', cast(n.n_nationkey AS string), '/c', cast(o.o_custkey AS string)) AS placement,
       c.c_mktsegment AS pool,
       CASE o.o_orderkey % 11 WHEN 0 THEN 'legacy' ELSE 'path' END AS executor,
       CASE o.o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'mpi' ELSE 'gpu,mpi' END AS capabilities,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE o.o_orderkey % 4 + 1 END AS max_attempts,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE o.o_orderkey % 8 + 2 END AS max_total,
       o.o_orderkey % 5 AS attempts, o.o_orderkey % 9 AS total_attempts,
       o.o_orderkey % 29 <> 0 AS readable, 1000 + o.o_orderkey % 2 AS owner_uid,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'pkg:site.a' WHEN 1 THEN 'installed' ELSE '' END AS runner,
       o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "fx_manager": """
SELECT s_suppkey AS manager_id,
       CASE s_suppkey % 6 WHEN 0 THEN 'path,legacy' ELSE 'path' END AS executors,
       CASE s_suppkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY,BUILDING' WHEN 2 THEN 'AUTOMOBILE' WHEN 3 THEN 'FURNITURE,HOUSEHOLD' ELSE '' END AS pools,
       s_suppkey % 10 = 0 AS accept_any_pool,
       CASE s_suppkey % 3 WHEN 0 THEN 'gpu,mpi' WHEN 1 THEN 'mpi' ELSE '' END AS capabilities,
       CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('r', cast(s_nationkey % 5 AS string)) WHEN 2 THEN concat('r', cast(s_nationkey % 5 AS string), '/n', cast(s_nationkey AS string))
         ELSE concat('r', cast(s_nationkey % 5 AS string), ',r1/n3,r1') END AS placement_prefixes,
       1000 + s_suppkey % 2 AS uid, s_suppkey % 7 = 0 AS searches,
       CASE s_suppkey % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'site.a,other' ELSE '' END AS runner_modules,
       (s_suppkey * 37) % 1800 AS heartbeat_age_seconds
FROM {supplier}""",
    "fx_frame": """
SELECT job_id, generation, event_id,
       CASE event_type WHEN 'signup' THEN 'ready' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'committing' ELSE 'failed' END AS kind,
       ts AS created_at,
       activation_no % 3 AS activation_id,
       CASE WHEN attempt_no = 0 THEN NULL ELSE attempt_no END AS attempt_id,
       CASE WHEN event_type = 'error' THEN concat('code', cast(event_id % 5 AS string)) END AS failure_code,
       CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'advance' WHEN 1 THEN 'wait' WHEN 2 THEN 'succeed' END END AS outcome_action,
       CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' MINUTE END AS started_at,
       concat('s', cast(event_id % 6 AS string)) AS step, CASE WHEN event_id % 5 = 0 THEN 'retry' END AS reason,
       event_id % 97 = 0 AS is_error,
       props
FROM (SELECT user_id AS job_id, event_id, ts, event_type, props,
             cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS generation,
             cast(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS activation_no,
             cast(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS attempt_no
      FROM {events}) e""",
    "fx_child": """
SELECT l_orderkey AS parent_id,
       CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'succeeded' WHEN 'NF' THEN 'succeeded' WHEN 'RF' THEN 'failed' WHEN 'NO' THEN 'running' WHEN 'AO' THEN 'succeeded' ELSE 'cancelled' END AS kind,
       l_partkey % 50 <> 0 AS resolved,
       l_partkey AS child_id, l_linenumber AS line, l_suppkey AS supp, l_shipdate AS shipped, l_extendedprice AS price
FROM {lineitem}""",
    "fx_join": """
SELECT o_orderkey AS parent_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'all_succeeded' WHEN 1 THEN 'all_terminal' WHEN 2 THEN 'any_succeeded' WHEN 3 THEN 'any_terminal' ELSE 'at_least' END AS cond,
       CASE WHEN o_orderkey % 5 = 4 THEN o_orderkey % 3 + 1 END AS k,
       o_orderkey % 2 = 0 AS has_on_impossible
FROM {orders}""",
    "fx_file": """
SELECT l_orderkey AS job_id, l_shipdate AS mtime, l_extendedprice AS size_bytes,
       CASE (l_linenumber + l_partkey) % 9 WHEN 0 THEN 'attempt_control' WHEN 1 THEN 'transaction_trash' WHEN 2 THEN 'retired_bundles' WHEN 3 THEN 'transfer_records' WHEN 4 THEN 'tmp_entries'
         WHEN 5 THEN 'retired_requests' WHEN 6 THEN 'journal_segments' WHEN 7 THEN 'manager_directories' ELSE 'placement_directories' END AS category,
       concat('f', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS name
FROM {lineitem}""",
    "fx_current": """
SELECT o_orderkey AS job_id,
       CASE WHEN o_orderkey % 43 = 0 THEN 'record cannot be read' END AS state_error,
       CASE WHEN o_orderkey % 13 > 0 THEN o_custkey % 127 END AS manager_id,
       CASE WHEN o_orderkey % 3 > 0 THEN 100 * (o_orderkey % 17) END AS lease_seconds,
       CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 4 END AS activation_id,
       o_custkey % 2 = 1 AS persistent,
       CASE o_custkey % 3 WHEN 0 THEN 'h0' WHEN 1 THEN 'h1' END AS writer_host,
       CASE o_custkey % 4 WHEN 0 THEN 'rename refused' WHEN 1 THEN '' END AS wedge,
       CASE WHEN o_custkey % 5 > 0 THEN concat('code', cast(o_custkey % 5 AS string)) END AS failure_code,
       CASE WHEN o_custkey % 2 = 0 THEN concat('m', cast(o_custkey AS string)) END AS failure_message,
       CASE WHEN o_custkey % 6 > 0 THEN 'all_succeeded' END AS condition,
       CASE WHEN o_custkey % 4 > 0 THEN 's1' END AS next_step,
       CASE WHEN o_custkey % 7 > 0 THEN concat('t', cast(o_custkey AS string)) END AS unresolved_since,
       CASE WHEN o_custkey % 3 > 0 THEN concat('op', cast(o_custkey % 3 AS string)) END AS operator,
       CASE WHEN o_custkey % 5 = 0 THEN 'stop' END AS operator_reason,
       CASE WHEN o_custkey % 6 = 0 THEN 'process_exited' END AS evidence,
       CASE WHEN o_orderkey % 23 = 0 THEN 'op1' END AS pause_by, CASE WHEN o_orderkey % 46 < 2 THEN 'later' END AS pause_reason
FROM {orders}""",
    "fx_request": """
SELECT l_orderkey AS job_id, concat('q', cast(l_linenumber AS string), '-', cast(l_partkey AS string)) AS request_id,
       CASE l_linenumber % 5 WHEN 0 THEN 'continue' WHEN 1 THEN 'cancel' WHEN 2 THEN 'pause' WHEN 3 THEN 'override_step' END AS action,
       CASE WHEN l_suppkey % 3 > 0 THEN concat('op', cast(l_suppkey % 3 AS string)) END AS operator,
       CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 4 END AS retired_at,
       CASE WHEN l_partkey % 4 > 0 THEN concat('reason', cast(l_partkey % 4 AS string)) END AS reason
FROM {lineitem}""",
    "fx_breadcrumb": """
SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 5 > 0 THEN concat('s', cast(o_custkey % 5 AS string)) END AS step, 'ValueError' AS exception, concat('bad ', cast(o_custkey AS string)) AS message
FROM {orders} WHERE o_custkey % 3 = 1""",
    "fx_ledger": """
SELECT o_orderkey * 4 AS job_id, concat('x', cast(o_orderkey AS string)) AS transfer_id, concat('o--', cast(o_orderkey * 4 AS string)) AS job_key,
       CASE o_orderkey % 5 WHEN 0 THEN 'received' ELSE 'sealed' END AS status,
       CASE o_orderkey % 7 WHEN 0 THEN 'elsewhere' ELSE 'dest' END AS destination_workspace_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE 'hub' END AS destination_remote,
       CASE o_orderkey % 4 WHEN 0 THEN 'paused' WHEN 1 THEN 'failed' ELSE 'succeeded' END AS prior_kind,
       concat('r', cast(o_custkey % 5 AS string), '/n', cast(o_custkey % 25 AS string)) AS placement,
       o_orderkey % 9 <> 0 AS has_bundle, CASE WHEN o_orderkey % 11 = 0 THEN 'manifest disagrees' END AS problem
FROM {orders} WHERE o_orderkey % 3 <> 1""",
    "fx_edge": """
SELECT p_partkey AS child, cast(floor(p_partkey / 2) AS bigint) AS parent FROM {part} WHERE p_partkey >= 1
UNION
SELECT p_partkey AS child, cast(floor(p_partkey / 3) AS bigint) AS parent FROM {part} WHERE p_partkey >= 1""",
    "fx_declaration": """
SELECT coalesce(d.doc_id, l.doc_id) AS job_id, d.lang AS declared, l.quality AS observed
FROM {documents} d FULL OUTER JOIN (SELECT doc_id + 1 AS doc_id, quality FROM {labels}) l ON d.doc_id = l.doc_id""",
}
VIEWS["fx_marker"] = f"""
SELECT j.job_id, CASE WHEN j.job_id % 37 = 0 THEN 'o--x' ELSE j.job_key END AS job_key, j.placement, j.priority,
       coalesce(CASE WHEN j.job_id % 13 = 0 THEN 'paused' END, f.kind, CASE WHEN j.job_id % 41 = 0 THEN 'ready' ELSE 'submitted' END) AS kind,
       coalesce(f.generation, 0) AS generation,
       CASE WHEN f.event_id IS NULL THEN 'init' WHEN f.event_id % 11 = 0 THEN 'w-1' ELSE concat('w', cast(f.event_id AS string)) END AS record_ref,
       'state' AS format, CASE WHEN j.job_id % 43 = 0 THEN 1 ELSE 2 END AS format_version, 'ws' AS workspace_id
FROM ({VIEWS["fx_job"]}) j LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY generation DESC) AS newest FROM ({VIEWS["fx_frame"]}) g) h WHERE newest = 1) f
  ON f.job_id = j.job_id"""
VIEWS["fx_record"] = f"""
SELECT *, concat('w', cast(event_id AS string)) AS record_ref, concat('o--', cast(job_id AS string)) AS job_key, CASE WHEN event_id % 31 = 1 THEN 'note' ELSE 'state' END AS format, CASE WHEN event_id % 37 = 1 THEN 1 ELSE 2 END AS format_version,
       CASE WHEN event_id % 41 = 1 THEN 'elsewhere' ELSE 'ws' END AS workspace_id, event_id % 9 = 4 AS unclean_restart,
       event_id % 150 AS manager_id, CASE WHEN event_id % 2 = 0 THEN 100 * (event_id % 13) END AS lease_seconds,
       CASE WHEN generation > 1 THEN lag(concat('w', cast(event_id AS string))) OVER (PARTITION BY job_id ORDER BY generation)
         WHEN job_id % 10 = 3 THEN first_value(concat('w', cast(event_id AS string))) OVER (PARTITION BY job_id ORDER BY generation DESC)
         WHEN job_id % 10 = 4 THEN 'w-2' END AS previous_record_ref
FROM ({VIEWS["fx_frame"]}) r"""
# Braces are written by code point, as the texts themselves name tables in braces.
VIEWS["fx_document"] = f"""
SELECT job_key, CASE WHEN job_id % 19 = 0 THEN concat(chr(123), '"job_key":') WHEN job_id % 31 = 0 THEN '[1]' ELSE
  concat(chr(123), '"job_key":"', CASE WHEN job_id % 17 = 0 THEN 'other' ELSE job_key END, '","priority":', cast(CASE WHEN job_id % 7 = 0 THEN 1 ELSE priority END AS string),
         ',"name":"n', cast(job_id % 100 AS string), '","workflow":"f', cast(job_id % 5 AS string), '","initial_step":"s', cast(job_id % 3 AS string),
         '","runner":', chr(123), '"executor":"', executor, '"', chr(125), ',"claim":', chr(123), '"pool":"', pool, '"', chr(125),
         ',"retry":', chr(123), '"attempts":', cast(job_id % 4 AS string), chr(125), chr(125)) END AS text
FROM ({VIEWS["fx_job"]}) d WHERE job_id % 23 <> 0"""
_TABLE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation as a DataFrame."""
    names = sorted(set(_TABLE.findall(VIEWS[name])))
    return spark.sql(VIEWS[name], **{n: table(spark, sf_dir, n) for n in names})


def cte(*names: str) -> str:
    """``WITH`` and the named relations, for the oracle."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_TABLE.sub(lambda m: m[1], VIEWS[n])})" for n in names)
