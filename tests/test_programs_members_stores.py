"""Collector programs under limits, members decoded in pieces, jobs stored once."""

import bz2
import gzip
import json
import lzma
import os
import random
import sqlite3
import sys
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from stateloom.plans import programs
from stateloom.sources import job_store, members

# Programs

BEGIN = "import sys, json, time\nsay = lambda x: print(json.dumps(x), flush=True)\n"
LOOP = "for line in sys.stdin:\n    r = json.loads(line); k = r['key']\n"


def program(body, begin='say({"ready": 1})\n', loop=LOOP):
    return [sys.executable, "-u", "-c", BEGIN + begin + loop + "".join(f"    {x}\n" for x in body.splitlines())]


def asked(argv, n, **limits):
    with programs.Program(argv, programs.Limits(**limits)) as p:
        began = time.monotonic()
        out = p.ask([(i, json.dumps({"key": i, "record": {"x": i}})) for i in range(n)])
        return out, p.starts, time.monotonic() - began


def test_answers_in_any_order_and_noise():
    out, starts, _ = asked(program("if k % 2 == 0: held = k; continue\nprint('noise')\nsay({'key': k, 'outputs': {'y': 2 * k}}); say({'key': held, 'error': 'even'})"), 1000)
    assert starts == 1 and len(out) == 1000
    assert out[7] == {"outputs": {"y": 14}} and out[8] == {"error": "even"}


def test_a_program_lives_as_long_as_its_partition(spark):
    argv = program("say({'key': k, 'outputs': {'pid': os.getpid(), 'y': r['record']['x'] * 2}})", begin="import os\nsay({'ready': 1})\n")
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)], "job_id long, x double").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    got = programs.run_program(rows, argv).select("job_id", "error", F.from_json("outputs", "pid long, y double").alias("o")).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.job_id: r.o.y for r in got} == {i: 2.0 * i for i in range(50)} and len({r.o.pid for r in got}) == 2


def test_a_program_that_dies_costs_the_records_at_hand():
    out, starts, _ = asked(program("if k == 10: sys.stderr.write('first\\nout of memory\\n'); sys.exit(3)\nsay({'key': k, 'outputs': {}})"), 20, window=4)
    lost = {k for k, a in out.items() if "error" in a}
    assert starts == 2 and 10 in lost and lost <= set(range(7, 14)) and {out[k]["error"] for k in lost} == {"out of memory"}
    out, starts, _ = asked(program("sys.exit(3)"), 50, window=4, restarts=2)
    assert starts == 3 and {a["error"] for a in out.values()} == {"exit code 3"} and len(out) == 50


def test_limits_of_time_and_of_lines():
    out, _, seconds = asked(program("if k == 3: time.sleep(60)\nsay({'key': k, 'outputs': {}})"), 8, window=2, answer_seconds=1.0)
    assert seconds < 20 and "in time" in out[3]["error"] and out[7] == {"outputs": {}}
    out, _, seconds = asked(program("pass", begin="time.sleep(60)\n"), 2, start_seconds=0.5, restarts=0)
    assert seconds < 10 and "not ready" in out[0]["error"] and "not ready" in out[1]["error"]
    assert "expected" in asked(program("pass", begin="say([1])\n"), 1, restarts=0)[0][0]["error"]
    out, _, _ = asked(program("say({'key': k, 'outputs': 'x' * (5000 if k == 2 else 5)})"), 6, window=1, line_bytes=1000)
    assert "more than 1000 bytes" in out[2]["error"] and out[3] == {"outputs": "xxxxx"}


def test_back_pressure_bounds_what_is_under_way():
    """A program that reads nothing for a while gets no more than its window."""
    argv = program("time.sleep(0.01)\nsay({'key': k, 'outputs': 'y' * 1000})")
    with programs.Program(argv, programs.Limits(window=8)) as p:
        most = []
        send = p._send
        p._send = lambda line: (send(line), most.append(len(p.unsent)))[0]
        out = p.ask([(i, json.dumps({"key": i, "record": "z" * 100_000})) for i in range(60)])
    assert len(out) == 60 and all("outputs" in a for a in out.values()) and max(most) < 2 * 100_100


# Members


def rows_of(content, most_line=1 << 20, piece=1 << 16):
    return list(members.lines_of(content, most_line, piece))


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress])
def test_lines_of_members(pack):
    rng = random.Random(3)
    texts = ["", "\n", "a", "a\n", "a\n\nb", "é漢😀\n" * 50, "x" * 70_000 + "\ny", "\n".join("w" * rng.randrange(300) for _ in range(500))]
    for text in texts:
        want, at = [], 0
        for i, line in enumerate(text.split("\n")):
            want.append((i, 0, at, line, None))
            at += len(line.encode()) + 1
        want = want[:-1] if text.endswith("\n") or not text else want
        for piece in (7, 1000, 1 << 16):
            assert rows_of(pack(text.encode()), piece=piece) == want
    long = ("é" * 1000).encode()
    parts = rows_of(pack(long), most_line=301)
    assert "".join(r[3] for r in parts) == long.decode() and all(len(r[3].encode()) <= 301 for r in parts)
    assert [r[1] for r in parts] == list(range(len(parts))) and all(r[2] == sum(len(q[3].encode()) for q in parts[:i]) for i, r in enumerate(parts))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_streams_in_a_row_and_damaged_tails(pack):
    assert [r[3] for r in rows_of(pack(b"a\nb") + pack(b"c\nd\n"))] == ["a", "bc", "d"]
    assert [r[3] for r in rows_of(pack(b"a\n") + b"\0" * 9)] == ["a"]
    whole = pack("".join(f"line {i} {random.Random(i).random()}\n" for i in range(60_000)).encode())
    cut = rows_of(whole[: len(whole) * 2 // 3])
    assert cut[-1][3] is None and cut[-1][4] and cut[-1][0] == len(cut) - 1
    assert all(r[4] is None for r in cut[:-1]) and [r[3].split()[1] for r in cut[:-2]] == [str(i) for i in range(len(cut) - 2)]
    garbage = rows_of(pack(b"a\n") + b"other bytes")
    assert [r[3] for r in garbage] == ["a", None] and "behind" in garbage[-1][4]


def test_a_large_member_needs_little_memory():
    packed = bz2.compress(b"the same line of forty bytes or some more\n" * 3_000_000)
    tracemalloc.start()
    n = sum(1 for _ in members.lines_of(packed, 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3_000_000 and peak < 4 << 20


def test_members_of_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("log", b"plain\n"), ("log.bz2", bz2.compress(b"packed\n")), ("out.gz", gzip.compress(b"1\n2\n")), ("out.xz", lzma.compress(b"3\n"))):
        (tmp_path / "a" / name).write_bytes(data)
    files = members.preferred_members(members.read_members(spark, str(tmp_path)))
    got = members.member_lines(files, ["name"], batch_chars=10).orderBy("name", "line_no").collect()
    assert [(r.name, r.line) for r in got] == [("log", "plain"), ("out", "1"), ("out", "2")]


# Stores

ITEM = "array<struct<id: string, kind: string, body: string>>"
COLLECTED = f"job_id string, run struct<id: string, body: string>, entries {ITEM}, products {ITEM}, degraded string"


def job(i, version=1, degraded=None):
    return (f"j{i}", (f"run{i}", f"v{version}"), [(f"e{i}-{k}", "entry", f"v{version}") for k in range(3)], [(f"p{i}", None, "body")], degraded)


def held(folder, table):
    out = []
    for name in sorted(os.listdir(folder)):
        with sqlite3.connect(f"{folder}/{name}") as db:
            out += db.execute(f"SELECT * FROM {table}").fetchall()
    return sorted(out)


def test_jobs_are_stored_once_and_replaced_whole(spark, tmp_path):
    connect = job_store.SqliteShards(str(tmp_path / "db"))
    rows = [job(i) for i in range(30)] + [job(99, degraded="no collector"), ("bad", ("runx", "b"), [("e", "k", None)], None, None)]
    for _ in range(2):
        reports = {r.job_id: r for r in job_store.store_collected(spark.createDataFrame(rows, COLLECTED).repartition(5), connect, shards=4).collect()}
        assert len(reports) == 32 and reports["j99"].skipped == "degraded" and "could not store job bad" in reports["bad"].storage_error
        assert json.loads(reports["j7"].stored) == {"entries": ["e7-0", "e7-1", "e7-2"], "run": "run7"}
        assert len(held(tmp_path / "db", "jobs")) == 30 and len(held(tmp_path / "db", "entries")) == 90 and len(held(tmp_path / "db", "runs")) == 30
    job_store.store_collected(spark.createDataFrame([job(7, 2)], COLLECTED), connect, shards=4)
    assert [r[3] for r in held(tmp_path / "db", "entries") if r[0] == "j7"] == ["v2"] * 3 and len(held(tmp_path / "db", "entries")) == 90
    assert len(os.listdir(tmp_path / "db")) == 4


class Dying:
    """A connection whose task is killed inside the third job's transaction."""

    def __init__(self, db):
        self.db, self.begun = db, 0

    def execute(self, text, *values):
        self.begun += text.startswith("BEGIN")
        if self.begun == 3 and text.startswith("INSERT INTO jobs"):
            raise KeyboardInterrupt
        return self.db.execute(text, *values)

    def executemany(self, *a):
        return self.db.executemany(*a)

    def close(self):
        self.db.close()


def test_a_killed_task_leaves_whole_jobs_and_its_retry_adds_the_rest(tmp_path):
    connect = job_store.SqliteShards(str(tmp_path / "db"))
    as_row = lambda j: {"job_id": j[0], "shard": 0, "run": dict(zip(("id", "body"), j[1])), "entries": [dict(zip(("id", "kind", "body"), e)) for e in j[2]], "products": [], "degraded": None}
    rows = [as_row(job(i)) for i in range(6)]
    with pytest.raises(KeyboardInterrupt):
        list(job_store.store_rows(iter(rows), lambda shard: Dying(connect(shard))))
    assert [r[0] for r in held(tmp_path / "db", "jobs")] == ["j0", "j1"] and len(held(tmp_path / "db", "entries")) == 6
    assert len(list(job_store.store_rows(iter(rows), connect))) == 6
    assert [r[0] for r in held(tmp_path / "db", "jobs")] == [f"j{i}" for i in range(6)] and len(held(tmp_path / "db", "entries")) == 18
