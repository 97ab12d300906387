import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stateloom.functions import documents, lattice, scalars
from stateloom.operators import census, dag, predicates, structures, textlog, upkeep
from stateloom.plans import collect
from stateloom.sources import journal, records, scratch
from stateloom.streaming import decisions, logs, state_machine


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column).first()[0]


def test_base36_covers_unsigned_64_bits(spark):
    for n in (0, 35, 36, 2**63, 2**64 - 1):
        text = one(spark, scalars.to_base36(F.lit(str(n))))
        assert int(text, 36) == n and one(spark, scalars.from_base36(F.lit(text))) == n
    assert one(spark, scalars.from_base36(F.lit("Z"))) is None


def test_placements_are_component_wise(spark):
    df = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/bc",), ("a",)], "p string")
    assert [r.p for r in df.where(scalars.under_placement(F.col("p"), "a/b")).collect()] == ["a/b", "a/b/c"]
    assert [one(spark, scalars.valid_placement(F.lit(p))) for p in ("a/b", "", "a//b", "../a", "/a", "a" * 256)] == [True] + [False] * 5


def test_marker_paths_keep_faults(spark):
    job = str(uuid.uuid4())
    good = f"ready/a/b/tag--{job}.p007.g1z.ref"
    rows = [(good,), ("odd/a/x",), ("ready/x",), ("ready/a/nonsense",), ("ready/a/short.p001.g1.r",)]
    got = records.markers_from_paths(spark.createDataFrame(rows, "path string")).collect()
    assert len(got) == 5 and got[0].fault is None and all(r.fault for r in got[1:])
    assert (got[0].kind, got[0].placement, got[0].tag, got[0].job_id, got[0].priority, got[0].generation, got[0].record_ref) == ("ready", "a/b", "tag", job, 7, 71, "ref")


def test_present_null_and_absent_members_differ(spark):
    df = spark.createDataFrame([('{"a": null}',), ("{}",), ('{"a": 1}',)], "t string").select(F.parse_json("t").alias("v"))
    assert [r[0] for r in df.select(scalars.absent_or_null(F.col("v"), "$.a")).collect()] == ["null", "absent", "present"]


def test_tolerant_casts_and_kinds(spark):
    values = {"true": None, "3": 3, "-2.7": -2, '"42"': 42, '"x"': None}
    for text, expected in values.items():
        assert one(spark, scalars.tolerant_int(F.parse_json(F.lit(text)))) == expected
    kinds = {"true": "boolean", "1.5": "float", '"a"': "string", "[true]": "list of boolean", "[1, 2]": "list of float", '[1, "a"]': "list of string", '{"a": 1}': "dict"}
    for text, expected in kinds.items():
        assert one(spark, scalars.value_kind(F.parse_json(F.lit(text)))) == expected


def test_schedules_and_times(spark):
    assert one(spark, scalars.backoff_schedule(1.0, 2.0, 4.0, 9.0, 8)) == [1.0, 2.0, 4.0, 2.0]
    assert one(spark, scalars.aware_timestamp(F.lit("2026-01-01T00:00:00"))) is None
    assert one(spark, scalars.aware_timestamp(F.lit("2026-01-01T00:00:00Z"))) is not None
    assert one(spark, scalars.structure_tag(F.lit("dir/My Crystal (2).POSCAR"))) == "my-crystal-2-"
    assert one(spark, scalars.environment_variable(F.lit("a.b"), "X_")) == "X_A_B"


def test_documents(spark):
    assert one(spark, documents.canonical_json(F.lit('{"b": 1, "a": "é"}'))) == '{"a":"é","b":1}'
    assert one(spark, documents.canonical_json(F.lit("{"))) is None
    df = spark.createDataFrame([(7.0, 2.0), (1.0, 0.0), (-7.0, 2.0), (None, 1.0)], "x double, y double")
    cases = {
        "x // y if x > 2 else x / y": [3.0, None, -3.5, None],
        "x % y + 1": [2.0, None, 2.0, None],
        "-x + (+y)": [-5.0, -1.0, 9.0, None],
        "1 < x <= 7 and y": [2.0, 0.0, 0.0, None],
        "not (x or y)": [0.0, 0.0, 0.0, None],
        "max(x, y, 3) - min(x, y)": [5.0, 3.0, 10.0, None],
        "ceil(x / 2) + floor(x / 2) + int(x / 2)": [10.0, 1.0, -10.0, None],
        "sqrt(x) ** 2": [pytest.approx(7.0), 1.0, None, None],
        "round(x / 2) + abs(x)": [11.0, 1.0, 3.0, None],
        "x ** 9999": [None, 1.0, None, None],
        "True + (x == 7)": [2.0, 1.0, 1.0, None],
    }
    for text, expected in cases.items():
        assert [r[0] for r in df.select(documents.evaluated(text, {"x": F.col("x"), "y": F.col("y")})).collect()] == expected, text
    for text in ("__import__('os')", "x.y", "[x]", "x if", "'a'", "z", "abs(x, y)", "max(x)", "x @ y", "abs(k=x)", "lambda: x"):
        with pytest.raises(ValueError):
            documents.evaluated(text, {"x": F.col("x"), "y": F.col("y")})


def test_lattice(spark):
    cubic = [F.array(*map(F.lit, v)) for v in ((2.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 2.0))]
    assert one(spark, lattice.kpoint_grid(*cubic, density=10.0)) == [6, 6, 6]
    assert one(spark, lattice.kpoint_grid(cubic[0], cubic[0], cubic[2], density=10.0)) is None


def test_journal_skips_damage_and_stops_at_a_torn_tail(spark, tmp_path):
    header, writer = b"HDR1\n", uuid.uuid4().hex
    frames = [{"n": i, "k": "é"} for i in range(4)]
    whole = journal.encode_segment(frames, header)
    damaged = bytearray(whole)
    damaged[len(header) + 8 + 2] ^= 1
    (tmp_path / writer).mkdir()
    for name, data in (("1.hwj", whole), ("2.hwj", bytes(damaged)), ("10.hwj", whole[:-5]), ("3.hwj", b"other"), ("z.hwj", whole), ("X.hwj", whole)):
        (tmp_path / writer / name).write_bytes(data)
    got = journal.read_journal(spark, str(tmp_path), header).orderBy(*journal.physical_order()).collect()
    assert [(r.segment, json.loads(r.frame)["n"]) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (36, 0), (36, 1), (36, 2), (2, 1), (2, 2), (2, 3), (35, 0), (35, 1), (35, 2), (35, 3)]
    parsed = spark.createDataFrame([(r.record_ref,) for r in got], "ref string").select(scalars.parse_record_ref(F.col("ref")).alias("p")).select("p.*").collect()
    assert [(p.writer, p.segment, p.offset, p.length) for p in parsed] == [(writer, r.segment, r.offset, r.length) for r in got]


def test_logs_and_assignments(spark):
    lines = spark.createDataFrame([(1, 0, '{"kind": "headline", "message": "a"}'), (1, 1, "bad"), (1, 2, '{"kind": "headline", "message": "b"}'), (1, 3, '{"kind": "x"}')], "job_id int, line_no int, line string")
    assert records.last_headline(lines).first().headline == "b"
    tags = spark.createDataFrame([(1, 0, "ENCUT = 300 # low"), (1, 1, " encut=520"), (1, 2, "# NSW = 3")], "job_id int, line_no int, line string")
    assert [(r.name, r.value) for r in records.last_assignments(tags).collect()] == [("ENCUT", "520")]
    # The blank line that ends a block goes, other blank lines stay, and every start leaves a line.
    rows = ["a", "", "Following cartesian coordinates:", "b", " k-point   1 :  0.0  plane waves:  99", "x", " ", "", "c", "k-points in reciprocal lattice and weights: d"]
    text = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "k int, line_no int, line string")
    cut = textlog.BLOCK_REPLACEMENT
    assert [r.line for r in textlog.without_blocks(text, "k").orderBy("line_no").collect()] == ["a", "", cut, cut, "", "c", cut]


def test_merge_current_is_a_compare_and_swap(spark):
    current = spark.createDataFrame([(1, 3, "ready")], "job_id int, generation int, kind string")
    updates = spark.createDataFrame([(1, 4, "running"), (1, 4, "claimed"), (1, 9, "failed"), (2, 1, "ready"), (3, 2, "ready")], current.schema)
    for df in (updates, updates.repartition(5)):
        assert sorted(map(tuple, records.merge_current(current, df, "job_id", "generation").collect())) == [(1, 4, "claimed"), (2, 1, "ready")]


def test_sinks_keep_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "broken")], "id int, fault string")
    records.write_rows(rows, str(tmp_path / "good"), F.col("fault").isNotNull(), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "good")).count() == 1 and spark.read.json(str(tmp_path / "bad")).count() == 1


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "parent int, child int")
    assert {(r.node, r.level) for r in dag.dag_levels(edges).collect()} == {(1, 0), (4, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError):
        dag.dag_levels(spark.createDataFrame([(1, 2), (2, 1), (5, 6)], "parent int, child int"))
    bad = spark.createDataFrame([(1, [1, 2], [1])], "k int, a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        dag.scatter(bad, ["k"], ["a", "b"]).collect()
    shards = dag.scatter(spark.createDataFrame([(1, [5, 6]), (2, [])], "k int, a array<int>"), ["k"], ["a"])
    parents = spark.createDataFrame([(1,), (2,)], "k int")
    assert {(r.k, tuple(r.a)) for r in dag.gather(shards, parents, "k", "a").collect()} == {(1, (5, 6)), (2, ())}
    assert dag.duplicate_ports(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "target int, port string")).count() == 1
    assert [one(spark, dag.truthy(F.lit(v), k)) for v, k in ((0, "int"), ("", "string"), (False, "boolean"), (2, "int"))] == [False, False, False, True]


def test_poison_waits_for_settled_parents(spark):
    edges = [(1, 3, False), (2, 3, False), (3, 4, False), (1, 5, True), (1, 6, False), (6, 7, False), (8, 9, False), (9, 10, False), (1, 10, True), (2, 11, False), (1, 11, False)]
    states = [(1, "failed", False), (2, "pending", False), (6, "pending", True), (8, "stopped", False)] + [(n, "pending", False) for n in (3, 4, 5, 7, 9, 10, 11)]
    e = spark.createDataFrame(edges, "parent int, child int, barrier boolean")
    s = spark.createDataFrame(states, "node int, state string, tolerant boolean")
    # 3 and 11 wait for 2; 5 has a barrier only; 6 is tolerant; 9 stops and so does 10.
    expected = {(9, "stopped", 1), (10, "stopped", 2)}
    settled = s.withColumn("state", F.when(F.col("node") == 2, "completed").otherwise(F.col("state")))
    more = expected | {(3, "failed", 1), (11, "failed", 1), (4, "failed", 2)}
    assert set(map(tuple, dag.dag_poison(e, s).collect())) == expected
    assert set(map(tuple, dag.dag_poison(e, settled).collect())) == more


def test_argument_words(spark):
    words = lambda *a: one(spark, dag.argument_words(*a))
    lit, arr, none = F.lit, lambda *x: F.array(*map(F.lit, x)).cast("array<string>"), F.lit(None).cast("string")
    assert words(lit("boolean"), lit("-f"), lit(True), none, arr("true")) == ["-f"]
    assert words(lit("boolean"), lit("-f"), lit(True), none, arr("false")) == []
    assert words(lit("string"), lit("-p"), lit(None).cast("boolean"), none, arr("x")) == ["-p", "x"]
    assert words(lit("string"), lit("-p"), lit(False), none, arr("x")) == ["-px"]
    assert words(lit("array"), lit("-p"), lit(False), lit(","), arr("x", "y")) == ["-px,y"]
    assert words(lit("array"), lit("-p"), lit(True), none, arr("x", "y")) == ["-p", "x", "y"]
    assert words(lit("array"), none, lit(True), none, arr()) == [] == words(lit("string"), lit("-p"), lit(True), none, lit(None).cast("array<string>"))


def test_decisions(spark):
    limits = [F.lit(n) for n in (2, 5, 3, 9)]
    commit = lambda action, activations=0, retry=False: one(spark, decisions.commit_decision(F.lit(action), F.lit(retry), *limits, F.lit(activations), F.lit(2)))
    assert [commit("advance"), commit("advance", 1), commit("advance", 2)] == ["ready", "ready", "failed"]
    assert [commit(a) for a in ("succeed", "wait", "pause", "retry", "fail", "odd")] == ["succeeded", "waiting", "paused", "ready", "failed", "failed"]
    assert commit("fail", retry=True) == "ready"
    codes = F.array(F.lit("a"), F.lit("b"))
    assert [one(spark, decisions.attempt_failure(F.lit(c).cast("string"), codes)) for c in ("a", "z", None)] == ["retry", "failed", "failed"]
    assert [one(spark, decisions.release_claim(F.lit(n))) for n in (3, 0)] == [2, 0]
    lines = spark.sql("SELECT 1 AS source, TIMESTAMP'2026-01-01 00:00:00' AS last_at UNION ALL SELECT 2, TIMESTAMP'2026-01-01 00:09:59'")
    got = decisions.silent_sources(lines, F.lit("2026-01-01 00:10:00").cast("timestamp"), 600.0).collect()
    assert {(r.source, r.silent) for r in got} == {(1, True), (2, False)}


def test_documents_runs_and_edges(spark, tmp_path):
    for name, text in (("a", '{"x": 1}'), ("b", "{")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    got = {r.path[-10]: r for r in records.read_documents(spark, str(tmp_path)).select("path", "digest", F.to_json("document").alias("d")).collect()}
    assert got["a"].d == '{"x":1}' and got["b"].d is None and len(got["b"].digest) == 64
    runs = spark.createDataFrame([("t", "2026-01-01", "a"), ("t", "2026-01-02", "a"), ("t", "2026-01-02", "b"), ("u", "2025-01-01", "z")], "task string, date string, name string")
    assert {(r.task, r.date, r.name) for r in records.newest_runs(runs, "task", "date", "name").collect()} == {("t", "2026-01-02", "b"), ("u", "2025-01-01", "z")}
    good = f"ready/a/b/tag--{uuid.uuid4()}.p007.g1z.ref"
    assert records.scan_markers(records.markers_from_paths(spark.createDataFrame([(good,), ("x",)], "path string"))).count() == 1
    doc = lambda *r: spark.createDataFrame(r, "k int, t string").select("k", F.parse_json("t").alias("document"))
    merged = collect.run_edges(doc((1, '{"o": 1}'), (2, '{"o": 2}')), doc((2, '{"d": 2}'), (3, '{"d": 3}')), "k")
    assert {(r.k, r.d, r.origin) for r in merged.select("k", F.to_json("document").alias("d"), "origin").collect()} == {(1, '{"o":1}', "observed"), (2, '{"o":2}', "observed"), (3, '{"d":3}', "declared")}


def test_prefixes_and_scratch(spark):
    assert one(spark, predicates.path_prefixes(F.lit("a/b"))) == ["", "a", "a/b"]
    assert sorted(one(spark, predicates.least_prefixes(F.array(*map(F.lit, ("a/b", "a", "ab", "a")))))) == ["a", "ab"]
    assert scratch.scratch_table(spark.range(3)).count() == 3
    assert scratch.drop_scratch(spark) > 0


def test_collector_keeps_failed_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 0.0)], "job_id int, x double")
    got = collect.run_collector(rows, lambda r: {"y": 1 / r["x"]}, "y double").orderBy("job_id").collect()
    assert (got[0].y, got[0].error) == (0.5, None) and "ZeroDivisionError" in got[1].error
    with pytest.raises(ValueError):
        collect.collect_kinds(["running"])
    assert collect.collect_kinds(["failed", "succeeded", "failed"]) == ("failed", "succeeded")


def test_stream_equals_batch_and_ignores_replays(spark, tmp_path):
    rows = [(j, g, ["ready", "claimed", "running", "failed"][(j + g) % 4]) for j in range(6) for g in range(1, 9)]
    df = spark.createDataFrame(rows, "job_id long, generation long, kind string")
    for part in (df.where("generation < 4"), df.where("generation >= 4"), df.where("generation = 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = state_machine.replay(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"))
    order = ["job_id", "generation", "kind", "n_claims", "n_failures"]
    assert {tuple(r) for r in got.select(order).collect()} == {tuple(r) for r in state_machine.batch_state(df).select(order).collect()}


def test_stream_reports_silent_jobs_once(spark, tmp_path):
    import time

    folder, out = tmp_path / "in", []
    schema = "job_id long, generation long, kind string"
    spark.createDataFrame([(1, 1, "claimed"), (2, 1, "claimed")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = state_machine.progressed(spark.readStream.schema(schema).parquet(str(folder)), lease_ms=1000)
    write = lambda batch, _: out.extend(map(tuple, batch.select("job_id", "generation", "expired").collect()))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).foreachBatch(write).trigger(processingTime="1 second").start()
    for k in range(60):
        if len([r for r in out if r[2]]) >= 2:
            break
        time.sleep(1)
        if k in (5, 12, 20, 30):  # a batch lets Spark look at its timeouts
            spark.createDataFrame([(3, k, "claimed")], schema).coalesce(1).write.mode("append").parquet(str(folder))
    query.stop()
    assert {(1, 1, True), (2, 1, True)} <= set(out)
    assert len([r for r in out if r[0] == 1 and r[2]]) == 1


def test_retention_is_inclusive_and_unset_keeps(spark):
    files = spark.sql("SELECT 1 AS job_id, TIMESTAMP_NTZ'2026-01-01 00:00:00' AS mtime, 'a' AS category, 1.0 AS size_bytes")
    assert census.gc_candidates(files, "2026-01-11 00:00:00", {"a": 10.0}).count() == 1
    assert census.gc_candidates(files, "2026-01-10 23:59:59", {"a": 10.0}).count() == 0
    assert census.gc_candidates(files, "2030-01-01 00:00:00", {"a": None}).count() == 0
    assert predicates.aged(F.lit(1), F.lit(1), None) is not None


def test_structure_texts(spark):
    rng = random.Random(1)
    numbers = [0.1, 1.5, 2.0, -3.25, 1 / 3, 123456.789, 1e-4, 9.99e-5, 0.0, -0.0, 1e15, 1e16, 1e20, 1e-25, 1.2345678901234e-12, 1e300, -1e-300, 5e-324, 0.1 + 0.2]
    numbers += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in [*numbers, None]], "x double").select("x", structures.number_text("x").alias("t")).collect()
    assert [r.t for r in got] == [f"{x:.16g}" for x in numbers] + [None]
    good = "c [MAGMOM=1 2]\n1.0\n1 0 0\n0 1 0\n0 0 1\nSi O\n1 2\nDirect\n0 0 0\n"
    head = lambda t: one(spark, structures.header(F.lit(t)))
    assert head(good).fault is None and head(good).species == ["Si", "O"] and head(good).counts == [1, 2]
    for text, fault in ((None, "fewer"), ("a\n1\n", "fewer"), (good.replace("1.0", "s"), "invalid"), (good.replace("0 1 0", "0 1"), "invalid"), (good.replace("1 2\nD", "1 x\nD"), "invalid"), (good.replace("Si O", "Si"), "species"), (good.replace("1 2\nD", "1 -2\nD"), "species")):
        got = spark.createDataFrame([(text,)], "t string").select(structures.header(F.col("t")).alias("h")).first().h
        assert got.fault.startswith(fault)
    left = good.replace("0 0 1", "0 0 -1")
    assert one(spark, structures.right_handed(F.lit(good))) == good
    assert one(spark, structures.right_handed(F.lit(left))).split("\n")[4].split()[2] == "1"
    assert one(spark, structures.with_comment_of(F.lit(good), F.lit("new\nx"))) == good.replace("c [MAGMOM=1 2]", "new")
    assert one(spark, structures.with_comment_of(F.lit(good), F.lit(""))) is None
    with pytest.raises(ValueError):
        structures.scaled_lattice(F.lit(good), 0.0)
    with pytest.raises(Exception, match="no value for template name b"):
        one(spark, structures.rendered(F.lit("$a $b"), {"a": F.lit("1")}))
    assert one(spark, structures.rendered(F.lit("${a}b $$a $a"), {"a": F.lit("$b")})) == "$bb $a $b"


def test_a_bounded_scan_visits_all_in_windows(spark):
    entries = [(r, f"{r}{i:02}", i % 3 > 0) for r in "abc" for i in range(7)]
    df = spark.createDataFrame(entries, "root string, position string, included boolean")
    cursors, root, seen = spark.createDataFrame([], "root string, position string"), None, []
    for expected in (["a01", "a02", "a04"], ["b01", "b02", "b04"], ["c01", "c02", "c04"], ["a05", "b05", "c05"]):
        taken, kept = upkeep.bounded_scan(df, cursors, root, 3, 5)
        now = [r.position for r in taken.orderBy("root", "position").collect()]
        assert now == expected
        cursors, root = spark.createDataFrame([tuple(r) for r in kept.collect()], cursors.schema), upkeep.next_root(df, now[-1][0])
        seen += now
    assert len(seen) == len(set(seen)) and root == "a"
    assert upkeep.bounded_scan(df.limit(0), cursors, "b", 3, 5)[0].count() == 0


def test_a_live_manager_with_an_unknown_writer_frees_nothing(spark):
    segments = spark.createDataFrame([("w", 1), ("v", 1), ("u", 1)], "writer string, segment int")
    refs, none = spark.createDataFrame([("v", 1)], segments.schema), "writer string, heartbeat_age_seconds int"
    assert [r.writer for r in upkeep.free_segments(segments, refs, spark.createDataFrame([("u", 5), ("w", 999)], none), 10).collect()] == ["w"]
    assert upkeep.free_segments(segments, refs, spark.createDataFrame([(None, 5)], none), 10).count() == 0
    assert upkeep.free_segments(segments, refs, spark.createDataFrame([(None, 50)], none), 10).count() == 2


def test_failures_and_private_names(spark):
    from stateloom.plans import states

    df = spark.createDataFrame([("c", "m"), (None, "m"), (None, None), ("", None)], "code string, message string")
    failure, damaged = states.failure_of(F.col("code"), F.col("message"))
    assert [(r.f and r.f.code, r.d) for r in df.select(failure.alias("f"), damaged.alias("d")).collect()] == [("c", False), ("unknown", True), (None, False), ("", True)]
    assert [one(spark, upkeep.is_private(F.lit(n))) for n in ("job-state", "attempt.1", "data")] == [True, True, False]


def test_logs_are_followed_as_a_stream(spark, tmp_path):
    folder, checkpoint, out = tmp_path / "logs", str(tmp_path / "log"), str(tmp_path / "out")
    folder.mkdir()

    def pass_over():
        stream = logs.diagnosed(logs.follow(spark, str(folder)))
        stream.writeStream.option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.source, r.code) for r in spark.read.parquet(out).collect())

    (folder / "a.0.log").write_text("fine\nZPOTRF failed\n")
    assert pass_over() == [("a", "zpotrf")]
    (folder / "a.1.log").write_text("fine\n")
    (folder / "b.0.log").write_text("TOO FEW BANDS\n")
    (folder / "c.0.txt").write_text("ZPOTRF failed\n")
    assert pass_over() == [("a", "zpotrf"), ("b", "too_few_bands")]
    spoken = logs.last_spoken(logs.follow(spark, str(folder)))
    query = spoken.writeStream.outputMode("complete").format("memory").queryName("spoken").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.source, r.n_lines) for r in spark.table("spoken").collect()} == {("a", 3), ("b", 1)}
