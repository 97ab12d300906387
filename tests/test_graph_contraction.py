"""Levels and poison by contraction against plain Python, and how many jobs long chains take."""

import random

import pytest
from pyspark.sql import functions as F

from stateloom.operators import dag


def plain_poison(edges, states):
    """{node: (fate, turn)} round by round, from edges (parent, child, barrier) and {node: (state, tolerant)}."""
    now, out, turn = {n: s for n, (s, _) in states.items()}, {}, 0
    done = ("completed", "skipped", "failed", "stopped")
    above = {}
    for p, c, barrier in edges:
        above.setdefault(c, []).append((p, barrier))
    while True:
        turn += 1
        new = {}
        for n, parents in above.items():
            if now.get(n) != "pending" or any(now.get(p, "pending") not in done for p, _ in parents):
                continue
            bad = {now[p] for p, barrier in parents if not barrier}
            if "stopped" in bad:
                new[n] = "stopped"
            elif "failed" in bad and not states[n][1]:
                new[n] = "failed"
        if not new:
            return out
        now |= new
        out |= {n: (f, turn) for n, f in new.items()}


def graphs(rng):
    """Chains hung on chains, ladders, diamonds, trees: shapes that contract in several steps."""
    n = 60
    yield [(i, i + 1, rng.random() < 0.1) for i in range(n)]
    yield [(i, i + 1, False) for i in range(n)] + [(rng.randrange(i + 1), i + 1, rng.random() < 0.3) for i in range(n)]
    yield [(0, i, False) for i in range(1, 20)] + [(i, i + 20, False) for i in range(1, 20)] + [(i + 20, 99, rng.random() < 0.5) for i in range(1, 20)]
    yield [(rng.randrange(i), i, rng.random() < 0.2) for i in range(1, n)]
    yield [e for i in range(0, n, 2) for e in ((i, i + 2, False), (i, i + 3, False), (i + 1, i + 2, False), (i + 1, i + 3, True))]
    yield [(rng.randrange(i), i, rng.random() < 0.2) for i in range(1, n) for _ in range(2)]
    yield [(i, i + 1, False) for i in range(20)] + [(20, 15, False), (3, 40, False), (40, 41, False), (41, 42, False), (30, 31, False), (31, 30, False), (31, 43, False)]


def side_by_side(rng, n_times):
    """Many graphs as one, each with nodes of its own."""
    return [(p + 1000 * k, c + 1000 * k, barrier) for k, edges in enumerate(g for _ in range(n_times) for g in graphs(rng)) for p, c, barrier in edges]


def test_poison_equals_the_rule_round_by_round(spark):
    rng = random.Random(1)
    edges = side_by_side(rng, 6)
    nodes = sorted({n for e in edges for n in e[:2]})
    kinds = ["pending"] * 12 + ["failed", "stopped", "completed", "skipped", "running"]
    states = {n: (rng.choice(kinds), rng.random() < 0.1) for n in nodes if rng.random() < 0.97}
    states |= {n: (rng.choice(["failed", "stopped"]), False) for n in nodes if n % 1000 == 0}
    e = spark.createDataFrame(edges, "parent int, child int, barrier boolean")
    s = spark.createDataFrame([(n, k, t) for n, (k, t) in states.items()], "node int, state string, tolerant boolean")
    got = {r.node: (r.fate, r.turn) for r in dag.dag_poison(e, s).collect()}
    assert len(got) > 100 and got == plain_poison(edges, states)


def test_levels_of_wide_and_ragged_graphs(spark):
    rng = random.Random(5)
    edges = side_by_side(rng, 2)
    circles = [(p, c) for p, c, _ in edges if p // 1000 % 7 == 6]
    pairs = {(p, c) for p, c, _ in edges if p // 1000 % 7 != 6}
    level = {n: 0 for p in pairs for n in p}
    for _ in range(200):
        for p, c in pairs:
            level[c] = max(level[c], level[p] + 1)
    assert {r.node: r.level for r in dag.dag_levels(spark.createDataFrame(sorted(pairs), "parent int, child int")).collect()} == level
    with pytest.raises(ValueError, match="cycle"):
        dag.dag_levels(spark.createDataFrame(circles, "parent int, child int"))


def jobs_of(spark, n, name):
    spark.sparkContext.setJobGroup(name, name)
    chain = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    # Every thousandth node also waits for the root, every 7919th for a node far back.
    more = chain.where("child % 1000 = 0").select(F.lit(0).cast("long").alias("parent"), "child")
    back = chain.where("child % 7919 = 0").select((F.col("child") - 5000).alias("parent"), "child")
    placed = dag.dag_levels(chain.unionByName(more).unionByName(back))
    wrong = placed.where("node <> level").count()
    count = placed.count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return count, wrong, jobs


def test_a_chain_of_a_hundred_thousand_nodes_takes_logarithmic_jobs(spark):
    small, large = jobs_of(spark, 10_000, "small chain"), jobs_of(spark, 100_000, "large chain")
    assert small[:2] == (10_001, 0) and large[:2] == (100_001, 0)
    # Ten times the nodes: a few more doublings, and as many rounds as before but for those of more layers.
    assert large[2] <= 2 * small[2] and large[2] < 700


def test_no_table_of_nodes_passes_through_the_driver(spark, monkeypatch):
    """Every table that a step writes, and the result, is planned without a broadcast, however small the graph."""
    plans, write = [], dag.scratch_table
    keep = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df)
    monkeypatch.setattr(dag, "scratch_table", keep)
    edges = side_by_side(random.Random(3), 1)
    e = spark.createDataFrame([x for x in edges if x[0] // 1000 % 7 != 6], "parent int, child int, barrier boolean")
    dag.dag_levels(e)
    nodes = e.select(F.col("child").alias("node")).union(e.select("parent")).distinct()
    poisoned = dag.dag_poison(e, nodes.withColumn("state", F.when(F.col("node") % 1000 == 0, "failed").otherwise("pending")).withColumn("tolerant", F.lit(False)))
    plans.append(poisoned._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]
