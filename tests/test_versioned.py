"""The versioned current table: races, replays, crashes, and which partitions a batch rewrites."""

import os

import pytest
from pyspark.sql import functions as F

from stateloom.sources import versioned

SCHEMA = "job_id long, generation long, kind string"


def table(spark, path, partitions=8):
    return versioned.VersionedTable(spark, f"file://{path}", SCHEMA, "job_id", "generation", partitions)


def updates(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", expected long")


def current(t, version=None):
    return {r.job_id: (r.generation, r.kind) for r in t.read(version).collect()}


def test_merge_compares_generations(spark, tmp_path):
    t = table(spark, tmp_path)
    assert current(t) == {} and t.merge(updates(spark, [(i, 1, "ready", 0) for i in range(40)])) == 1
    rows = [(1, 2, "claimed", 1), (1, 2, "failed", 1), (2, 5, "ready", 4), (3, 2, "running", 1), (50, 1, "ready", 0), (51, 2, "ready", 1), (4, None, None, 1)]
    assert t.merge(updates(spark, rows)) == 2
    got = current(t)
    assert got[1] == (2, "claimed") and got[2] == (1, "ready") and got[3] == (2, "running") and got[50] == (1, "ready")
    assert 51 not in got and 4 not in got and len(got) == 40
    # An older version stays as it was.
    assert current(t, 1) == {i: (1, "ready") for i in range(40)}


def test_untouched_partitions_are_not_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(updates(spark, [(i, 1, "ready", 0) for i in range(200)]))
    before = t.snapshot()
    t.merge(updates(spark, [(7, 2, "claimed", 1)]))
    after = t.snapshot()
    changed = {p for p in after.folders if after.folders[p] != before.folders[p]}
    assert len(changed) == 1 and len(after.folders) == 8
    new = after.folders[changed.pop()].split("/_part=")[0]
    assert len([d for d in os.listdir(tmp_path / new) if d.startswith("_part=")]) == 1
    plan = t.lookup([7])._jdf.queryExecution().toString()
    assert current(t)[7] == (2, "claimed") and {r.kind for r in t.lookup([7]).collect()} == {"claimed"} and plan.count("_part=") <= 4


def test_of_two_writers_one_wins_and_the_other_decides_anew(spark, tmp_path):
    one, two = table(spark, tmp_path), table(spark, tmp_path)
    one.merge(updates(spark, [(1, 1, "ready", 0), (2, 1, "ready", 0)]))
    raced = []

    def overtaken():
        if not raced:
            raced.append(two.merge(updates(spark, [(1, 2, "claimed", 1)]), "two", 0))

    # Both saw version 1; the second publishes version 2 first, so the first one's claim no longer fits.
    version = one.merge(updates(spark, [(1, 2, "running", 1), (2, 2, "running", 1)]), "one", 0, meanwhile=overtaken)
    assert raced == [2] and version == 3
    assert current(one) == {1: (2, "claimed"), 2: (2, "running")}
    assert one.snapshot().applications == {"one": 0, "two": 0}
    named = {f.split("/")[1] for n in (1, 2, 3) for f in one.snapshot(n).folders.values()}
    assert set(os.listdir(tmp_path / "parts")) == named


def test_a_writer_that_never_gets_through_gives_up(spark, tmp_path):
    one, two = table(spark, tmp_path, 2), table(spark, tmp_path, 2)
    n = iter(range(100))
    with pytest.raises(versioned.Conflict):
        one.merge(updates(spark, [(1, 1, "a", 0)]), meanwhile=lambda: two.merge(updates(spark, [(next(n) + 10, 1, "b", 0)])), tries=2)
    assert sorted(current(one)) == [10, 11]


def test_publishing_by_rename_does_not_overwrite(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned.VersionedTable, "_link", versioned.VersionedTable._rename)
    t = table(spark, tmp_path)
    assert t._publish(versioned.Snapshot(1, {}, {"a": 1})) and not t._publish(versioned.Snapshot(1, {}, {"b": 1}))
    assert t.snapshot() == versioned.Snapshot(1, {}, {"a": 1})


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = updates(spark, [(1, 1, "ready", 0)])
    assert t.merge(rows, "s", 0) == 1 and t.merge(rows, "s", 0) is None and t.merge(updates(spark, [(1, 2, "claimed", 1)]), "s", 1) == 2
    assert t.merge(rows, "s", 1) is None and t.merge(rows, "s", 0) is None and t.snapshot().version == 2


def test_a_stream_into_the_table_with_a_killed_batch(spark, tmp_path):
    t, died = table(spark, tmp_path / "t"), []
    rows = [[(i, g, f"k{g}", g - 1) for i in range(20)] for g in (1, 2, 3)]
    for k, part in enumerate(rows):
        updates(spark, part).coalesce(1).withColumn("order", F.lit(k)).write.mode("append").parquet(str(tmp_path / "in"))

    def run(write):
        read = spark.readStream.schema(SCHEMA + ", expected long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        read.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    def killed_after_publishing(batch, number):
        t.sink("jobs")(batch, number)
        if number == 1:
            died.append(number)
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        run(killed_after_publishing)
    run(t.sink("jobs"))
    assert died == [1] and current(t) == {i: (3, "k3") for i in range(20)} and t.snapshot().version == 3
    assert t.vacuum(keep=1) == 2 and current(t) == {i: (3, "k3") for i in range(20)}
    assert len([n for n in os.listdir(tmp_path / "t" / "_versions") if n.endswith(".json") and not n.startswith(".")]) == 1
