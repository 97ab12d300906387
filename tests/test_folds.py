"""Folds against a plain Python model, on the cases that the test tables do not hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stateloom.operators import folds, joins

FRAMES = "job_id long, generation long, kind string, created_at timestamp, activation_id string, attempt_id string, failure_code string, outcome_action string, is_error boolean, started_at timestamp, step string, reason string"


def at(s):
    return datetime(2026, 1, 1, 0, 0, s)


def frame(g, kind, activation="a", attempt=None, code=None, outcome=None, error=False, time=True, began=None, step=None, reason=None):
    return (1, g, kind, at(g) if time else None, activation, attempt, code, outcome, error, at(began) if began else None, step, reason)


def model(rows):
    """Activations and attempts by walking the frames."""
    activations, attempts, current, own, no = [], [], object(), None, 0
    for _, g, kind, time, activation, attempt, code, outcome, error, began, _, _ in sorted(rows, key=lambda r: r[1]):
        if error:
            continue
        activation, attempt = activation or None, attempt or None
        if activation != current or not activations:
            current, own, no = activation, None, 0
            activations.append([activation, g, 0])
        activations[-1][2] += 1
        if kind == "claimed":
            no += 1
            own = dict(no=no, island=len(activations), id=attempt, claim=g, started=None, finished=None, code=None, outcome=None)
            attempts.append(own)
        elif own is not None and attempt == own["id"]:
            if kind == "running":
                own["started"] = began or time
            else:
                own["finished"] = own["finished"] or time
                own["code"] = own["code"] or code
                if kind == "committing":
                    own["outcome"] = outcome
    return activations, attempts


CASES = {
    "recurring activation": [frame(1, "ready", "a"), frame(2, "ready", "b"), frame(3, "ready", "a")],
    "error between equal ids": [frame(1, "ready"), frame(2, "ready", "b", error=True), frame(3, "running")],
    "null and empty ids": [frame(1, "ready", None), frame(2, "ready", ""), frame(3, "ready", "a"), frame(4, "ready", None)],
    "claimed twice": [frame(1, "claimed", attempt="x"), frame(2, "claimed", attempt="x"), frame(3, "running", attempt="x")],
    "null time": [frame(1, "claimed", attempt="x"), frame(2, "failed", attempt="x", code="c1", time=False), frame(3, "failed", attempt="x", code="c2")],
    "other attempt": [frame(1, "running", attempt="x"), frame(2, "claimed", attempt="y"), frame(3, "running", attempt="x"), frame(4, "committing", attempt="y", outcome="advance"), frame(5, "committing", attempt="y", outcome="succeed")],
    "the last commit and run count, even without outcome and time": [
        frame(1, "claimed", attempt="x"), frame(2, "running", attempt="x", began=40), frame(3, "running", attempt="x", time=False),
        frame(4, "committing", attempt="x", outcome="advance"), frame(5, "committing", attempt="x"),
    ],
    "own start": [frame(1, "claimed", attempt="x"), frame(2, "running", attempt="x", began=50)],
    "empty attempt id": [frame(1, "claimed", attempt=""), frame(2, "running"), frame(3, "failed", attempt="", code="c")],
    "failure while running": [frame(1, "claimed", attempt="x"), frame(2, "running", attempt="x", code="c"), frame(3, "running", attempt="x", time=False)],
}


@pytest.mark.parametrize("case", CASES)
def test_timeline(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, FRAMES)
    activations, attempts = model(rows)
    got = sorted(folds.timeline_activations(df).collect(), key=lambda r: r.activation_no)
    assert [[r.activation_id, r.first_generation, r.n_frames] for r in got] == activations
    found = sorted(folds.timeline_attempts(df).collect(), key=lambda r: r.claim_generation)
    # The model finishes an attempt at the first later frame with a time.
    assert [(r.attempt_no, r.activation_no, r.attempt_id, r.claim_generation, r.started_at, r.finished_at, r.failure_code, r.outcome_action) for r in found] == [
        (a["no"], a["island"], a["id"], a["claim"], a["started"], a["finished"], a["code"], a["outcome"]) for a in attempts
    ]


def test_children_by_label(spark):
    rows = [(1, "l", 7, "ready", 1), (1, "l", 7, None, 2), (1, "m", 5, "ready", 3), (1, "l", 8, None, 4), (1, "n", 1, "ready", 5), (1, "n", 2, "failed", 6), (1, "n", 1, None, 7)]
    got = joins.children_by_label(spark.createDataFrame(rows, "job_id long, label string, child long, kind string, position long")).orderBy("first_position").collect()
    assert [(r.label, r.child, r.kind) for r in got] == [("l", 8, None), ("m", 5, "ready"), ("n", 1, None)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], FRAMES)
    for f in (folds.transition_log, folds.timeline_activations, folds.timeline_attempts):
        assert f(df).count() == 0


@pytest.mark.parametrize(
    "cond, k, kinds, verdict",
    [
        ("all_succeeded", None, ["succeeded", "failed", "running"], "impossible"),
        ("all_succeeded", None, ["succeeded", "running"], "blocked"),
        ("any_succeeded", None, ["failed", "cancelled"], "impossible"),
        ("any_terminal", None, ["running"], "blocked"),
        ("at_least", 2, ["succeeded", "running", "failed"], "blocked"),
        ("at_least", 3, ["succeeded", "running", "failed"], "impossible"),
        ("at_least", 1, ["succeeded", "failed"], "satisfied"),
    ],
)
def test_verdicts(spark, cond, k, kinds, verdict):
    waits = spark.createDataFrame([(1, cond, k, True)], "parent_id long, cond string, k int, has_on_impossible boolean")
    children = spark.createDataFrame([(1, x) for x in kinds], "parent_id long, kind string")
    assert joins.join_verdicts(waits, children).select("verdict").first()[0] == verdict


def test_round_robin_starts_after_the_last_served(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "root string, n int")
    assert [tuple(r)[:2] for r in folds.round_robin(df, "root", "n", "a").collect()] == [("b", 1), ("c", 1), ("a", 1), ("a", 2)]
    assert df.select(joins.unresolved_grace(F.lit(3600.0))).first()[0]


def test_an_activation_has_step_and_reason_of_its_first_frame(spark):
    rows = [frame(1, "ready", step="s0"), frame(2, "claimed", step="s1", reason="r"), frame(3, "ready", "b", step=None, reason="q"), frame(4, "ready", "b", step="s2")]
    got = sorted(folds.timeline_activations(spark.createDataFrame(rows, FRAMES)).collect(), key=lambda r: r.activation_no)
    assert [(r.step, r.reason) for r in got] == [("s0", None), (None, "q")]
