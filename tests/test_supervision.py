"""Supervised runs: the stream against the batch fold, whatever the order, repeats and restarts."""

import random
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle

from stateloom.streaming import clocks, supervision as sv

# Workers can't import this module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
AT = datetime(2024, 1, 1)


def broken(state, event):
    if event["event"] == "tick" and event["number"] > 30:
        raise RuntimeError("lost")
    return state, [{"severity": "odd"}] if event["line"] == "odd" else []


CHECKERS = [
    sv.Checker("spin", sv.repeated_line("retry", 3, "spinning")),
    sv.Checker("quiet", sv.quiet_ticks(4)),
    sv.Checker("end", sv.missing_at_exit("converged", "not_converged")),
    sv.Checker("noise", lambda s, e: ({"n": s.get("n", 0) + 1}, [{"code": "noise", "severity": "info", "summary": str(s.get("n", 0)), "evidence": e["line"]}] if e["line"] == "x" else [])),
    sv.Checker("broken", broken),
]


def runs(seed, n_runs=8):
    rng, rows = random.Random(seed), []
    for r in range(n_runs):
        n = rng.randint(20, 80)
        for k in range(n):
            kind = "start" if k == 0 else rng.choice(["line", "line", "tick"])
            line = rng.choice(["retry a", "retry b", "x", "x", "y", "converged" if r % 2 else "z", "odd" if r == 3 else "y"]) if kind == "line" else None
            rows.append((r, k, kind, "out", line, AT))
        if r != 5:
            rows.append((r, n, "process-exit", "process", None, AT))
            rows.append((r, n + 1, "line", "out", "retry", AT))
    return rows


def out_of(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture
def rocks(spark):
    for k, v in clocks.needed_settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in clocks.needed_settings:
        spark.conf.unset(k)


def test_stream_equals_batch_in_any_order(rocks, tmp_path):
    rows = runs(4)
    want = out_of(sv.supervised_of(rocks.createDataFrame(rows, sv.SCHEMA), CHECKERS, keep=10))
    codes = " ".join(want)
    assert all(c in codes for c in ("spinning", "no_output", "not_converged", "noise", "diagnostics_truncated", "checker_protocol_error"))
    shuffled = rows + random.Random(1).sample(rows, 60)
    random.Random(2).shuffle(shuffled)
    for k in range(3):
        rocks.createDataFrame(shuffled[k::3], sv.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = rocks.readStream.schema(sv.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = sv.supervised(read, CHECKERS, keep=10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query.trigger(availableNow=True).start().awaitTermination()
    assert out_of(rocks.read.parquet(str(tmp_path / "out"))) == want


def folded(rows, checkers, keep=200):
    run, out = sv.new_run(), []
    for number, (event, line) in enumerate(rows):
        out += sv.applied(run, {"number": number, "event": event, "source": "out", "line": line, "at": ""}, checkers, keep)
    return out, run


def test_checkers_keep_state_between_lines():
    lines = [("line", x) for x in ("retry", "retry", "y", "retry", "retry", "retry", "retry")]
    out, run = folded(lines, CHECKERS[:1])
    assert [(d[0], d[1], d[6]) for d in out] == [(5, "spinning", True)] and run["stopped"]
    out, _ = folded([("tick", None)] * 9 + [("line", "y")] + [("tick", None)] * 4, CHECKERS[1:2])
    assert [d[0] for d in out] == [3, 13]


def test_a_broken_checker_is_asked_no_more():
    required = sv.Checker("r", lambda s, e: 1 / 0, required=True)
    out, run = folded([("line", "a")] * 3, [required])
    assert len(out) == 1 and out[0][2] == "fatal" and out[0][6] and run["stopped"]
    assert folded([("line", "odd")] * 2, [CHECKERS[4]])[0][0][1:3] == (sv.PROTOCOL_ERROR, "warning")
    unkeepable = sv.Checker("u", lambda s, e: ({"x": {1, 2}}, []))
    assert "TypeError" in folded([("line", "a")], [unkeepable])[0][0][3]


def test_the_first_and_last_diagnostics_are_kept():
    out, _ = folded([("line", "x")] * 50 + [("process-exit", None)], CHECKERS[3:4], keep=10)
    assert [d[0] for d in out] == [0, 1, 2, 3, 4, 50, 45, 46, 47, 48, 49]
    assert out[5][1] == sv.TRUNCATED and out[5][3].startswith("40 ")


def test_a_replay_keeps_to_its_number_of_batches(spark, tmp_path):
    import os

    from stateloom.streaming import state_machine

    rows = spark.range(60).selectExpr("id % 6 AS job_id", "1 + id div 6 AS generation", "CASE WHEN id % 3 = 0 THEN 'claimed' ELSE 'failed' END AS kind")
    rows.repartition(3, "job_id").sortWithinPartitions("generation").write.option("maxRecordsPerFile", 4).parquet(f"{tmp_path}/frames")
    got = state_machine.replay(spark, f"{tmp_path}/frames", rows.schema, f"{tmp_path}/checkpoint", most_batches=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state_machine.batch_state(rows).collect()))
    assert len([n for n in os.listdir(f"{tmp_path}/checkpoint/states") if n.startswith("batch=")]) <= 3
