"""Small readers, run-log lines, timestamps and outputs on hand-made files and rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stateloom.functions.scalars import timestamp_seconds
from stateloom.operators import dataflow
from stateloom.plans import outputs
from stateloom.sources import records


def test_breadcrumbs_ledgers_and_settings(spark, tmp_path):
    for name, text in (("job/attempt.1/error.json", '{"code": "x"}'), ("job/attempt.2/error.json", "{"), ("transfers/b.json", '{"transfer_id": "2", "job_id": "j", "prior_kind": "failed", "destination_placement": "p/q"}'), ("transfers/a.json", "[]"), ("format.json", '{"settings": {"a": 1, "b": {"c": [2]}}}')):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = {r.attempt: r.d for r in records.read_breadcrumbs(spark, str(tmp_path)).select("attempt", F.to_json("document").alias("d")).collect()}
    assert found == {"attempt.1": '{"code":"x"}', "attempt.2": None}
    ledgers = records.read_ledgers(spark, str(tmp_path)).collect()
    assert [(r.transfer_id, r.state, r.placement) for r in ledgers] == [(None, None, None), ("2", "failed", "p/q")]
    assert {r.name: json.loads(r.value) for r in records.read_settings(spark, str(tmp_path)).collect()} == {"a": 1, "b": {"c": [2]}}
    (tmp_path / "format.json").write_text("{}")
    assert records.read_settings(spark, str(tmp_path)).count() == 0


def test_runlog_lines_are_canonical(spark):
    events = spark.createDataFrame([(1, 0, "t0", "start", "é"), (1, 1, "t1", "end", None)], "job_id int, position int, timestamp string, kind string, message string")
    files = spark.createDataFrame([(1, 0, "b", b"2"), (1, 0, "a", b"x\xff")], "job_id int, position int, path string, content binary")
    made = {r.position: r.line for r in records.runlog_events(events, files).collect()}
    first = json.loads(made[0])
    assert [f["path"] for f in first["files"]] == ["a", "b"] and first["files"][1]["sha256"] == "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35"
    assert made[0] == json.dumps(first, sort_keys=True, separators=(",", ":"), ensure_ascii=False) and json.loads(made[1])["files"] == []
    for bad in (None, "", "a\0b"):
        with pytest.raises(Exception, match="run-log kind"):
            records.runlog_events(events.withColumn("kind", F.lit(bad).cast("string")), files).collect()


def test_timestamps(spark):
    texts = ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.123456Z", "2024-01-02T03:04:05+05:30", "2024-01-02 03:04", "2024-01-02", "nonsense", "2024-13-01", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(timestamp_seconds(F.col("t"))).collect()]
    utc = lambda t: datetime.fromisoformat(t).timestamp()
    assert got == [utc(t) for t in texts[:3]] + [utc("2024-01-02T03:04+00:00"), utc("2024-01-02T00:00+00:00"), None, None, None, None]


def test_outputs_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "{}"), (6, '{"a": null, "b": {"class": "File", "location": "file:///x/y"}}')]
    docs = spark.createDataFrame(rows, "job_id int, outputs string")
    roles = spark.createDataFrame([(6, "a", "r"), (6, "b", "s")], "job_id int, port string, role string")
    got = {(r.job_id, r.port): (r.kind, r.value, r.path, r.fault) for r in outputs.document_outputs(docs, roles).collect()}
    assert {k: v[3] for k, v in got.items() if k[1] is None} == {(i, None): "the document is no object" for i in (1, 2, 3, 4)}
    assert got[6, "b"] == ("file", None, "/x/y", None) and got[6, "a"][0] == "data" and (5, None) not in got


def test_items_may_give_null_scalars(spark):
    items = spark.createDataFrame([(1, None, ["tag"]), (2, None, [])], "k int, tag string, given array<string>")
    assert {r.k: (r.tag, r.priority) for r in dataflow.merged_jobs(items, {"tag": "t", "priority": 3}, "k").collect()} == {1: (None, 3), 2: ("t", 3)}
