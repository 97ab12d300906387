"""Appends to journals: what a reader sees after retries, replays, crashes and races."""

import json
import os
import subprocess
import sys
import textwrap
import uuid

import pytest
from pyspark.sql import functions as F

from stateloom.sources import journal, journal_sink

HEADER = b"HDR1\n"
WRITERS = [str(uuid.UUID(int=i)) for i in range(1, 4)]


def frames_of(spark, n, first=0):
    """n numbered frames; the first writer has most of them."""
    writer = F.element_at(F.array(*map(F.lit, WRITERS)), F.when(F.col("id") % 10 < 8, 1).when(F.col("id") % 10 == 8, 2).otherwise(3))
    rows = spark.range(first, first + n).select(writer.alias("writer"), "id")
    return rows.select("writer", F.to_json(F.struct(F.col("id").alias("n"), F.lit("é").alias("k"))).alias("frame"), "id")


def stored(spark, root):
    rows = journal.read_journal(spark, str(root), HEADER).select("writer", "segment", "offset", "frame").collect()
    by_place = sorted((r.writer, r.segment, r.offset, json.loads(r.frame)["n"]) for r in rows)
    return {w: [n for x, _, _, n in by_place if x == w] for w in WRITERS}


def expected(n, first=0):
    of = lambda i: WRITERS[0 if i % 10 < 8 else 1 if i % 10 == 8 else 2]
    return {w: [i for i in range(first, first + n) if of(i) == w] for w in WRITERS}


def test_segments_rotate_and_keep_each_writers_order(spark, tmp_path):
    frames = frames_of(spark, 500).repartition(7)
    journal_sink.append_journal(frames, str(tmp_path), HEADER, ["id"], most_bytes=1000, partitions=5)
    assert stored(spark, tmp_path) == expected(500)
    sizes = [os.path.getsize(tmp_path / w / f) for w in WRITERS for f in os.listdir(tmp_path / w)]
    assert max(sizes) <= 1000 and len(sizes) > 20
    names = sorted(os.listdir(tmp_path / WRITERS[0]), key=lambda f: int(f[:-4], 36))
    assert [f[:-4] for f in names] == [journal_sink.base36(i) for i in range(len(names))]
    # A second append goes behind the first.
    journal_sink.append_journal(frames_of(spark, 100, 500), str(tmp_path), HEADER, ["id"], most_bytes=1000)
    assert stored(spark, tmp_path) == expected(600)
    assert os.listdir(tmp_path / "_staging") == []


def test_a_replayed_version_is_appended_once(spark, tmp_path):
    for version, first in ((0, 0), (1, 50), (1, 50), (0, 0), (2, 100)):
        journal_sink.append_journal(frames_of(spark, 50, first), str(tmp_path), HEADER, ["id"], application="a", version=version)
    assert stored(spark, tmp_path) == expected(150)
    journal_sink.append_journal(frames_of(spark, 10, 150), str(tmp_path), HEADER, ["id"], application="b", version=0)
    assert stored(spark, tmp_path) == expected(160)
    assert len(os.listdir(tmp_path / "_commits")) <= journal_sink.KEPT_MANIFESTS + 1


def test_a_bad_frame_aborts_the_whole_write(spark, tmp_path):
    journal_sink.append_journal(frames_of(spark, 20), str(tmp_path), HEADER, ["id"])
    bad = frames_of(spark, 50, 20).withColumn("frame", F.when(F.col("id") == 60, "[1]").otherwise(F.col("frame")))
    with pytest.raises(Exception, match="JSON object"):
        journal_sink.append_journal(bad, str(tmp_path), HEADER, ["id"], partitions=4)
    assert stored(spark, tmp_path) == expected(20)
    assert os.listdir(tmp_path / "_staging") == []


def test_a_commit_that_died_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root, staged = str(tmp_path), []
    for i, w in enumerate([WRITERS[0], WRITERS[0], WRITERS[1]]):
        path = tmp_path / "_staging" / "x" / str(i)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(HEADER + journal_sink.encode_frame(json.dumps({"n": i})))
        staged.append((w, str(path)))
    links = []

    def dies(a, b, link=os.link):
        if not b.endswith(".json"):
            links.append(b)
            if len(links) == 2:
                raise OSError("killed")
        link(a, b)

    monkeypatch.setattr(os, "link", dies)
    with pytest.raises(OSError, match="killed"):
        journal_sink.publish(root, staged, ".hwj", "a", 7)
    monkeypatch.undo()
    assert stored(spark, root)[WRITERS[0]] == [0]
    # The retry of the same version finds it recorded, finishes it and adds nothing.
    assert journal_sink.publish(root, staged, ".hwj", "a", 7) is False
    assert stored(spark, root) == {WRITERS[0]: [0, 1], WRITERS[1]: [2], WRITERS[2]: []}


def test_two_commits_cannot_take_one_number(spark, tmp_path, monkeypatch):
    root = str(tmp_path)

    def segment(n):
        path = tmp_path / "_staging" / str(n)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(HEADER + journal_sink.encode_frame(json.dumps({"n": n})))
        return [(WRITERS[0], str(path))]

    raced = []

    def overtaken(a, b, link=os.link):
        if b.endswith(".json") and not raced:
            raced.append(b)
            journal_sink.publish(root, segment(1), ".hwj", None, None)
        link(a, b)

    monkeypatch.setattr(os, "link", overtaken)
    assert journal_sink.publish(root, segment(2), ".hwj", None, None)
    assert stored(spark, root)[WRITERS[0]] == [1, 2]


def test_killed_and_retried_tasks_leave_no_frame_twice(tmp_path):
    """Real task retries: the first attempts of two tasks die after staging segments."""
    script = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {os.getcwd()!r})
        from pyspark.sql import SparkSession
        from tests_frames import frames_of, HEADER
        from stateloom.sources import journal_sink
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()

        def dies_once(self, writer, frame, add=journal_sink._Segments.add):
            add(self, writer, frame)
            mark = {str(tmp_path)!r} + "/died-" + os.path.basename(self.folder)[:6]
            if len(self.out) == 2 and not os.path.exists(mark):
                open(mark, "x").close()
                os._exit(1)

        class Dying(journal_sink._BatchWriter):
            def write(self, rows):
                journal_sink._Segments.add = dies_once
                return super().write(rows)

        class DyingSink(journal_sink.JournalSink):
            def writer(self, schema, overwrite):
                return Dying(self.options)

        journal_sink.JournalSink = DyingSink
        journal_sink.append_journal(frames_of(spark, 400), {str(tmp_path / "j")!r}, HEADER, ["id"], most_bytes=1000, partitions=3)
    """)
    (tmp_path / "run.py").write_text(script)
    (tmp_path / "tests_frames.py").write_text(
        f"from pyspark.sql import functions as F\nHEADER, WRITERS = {HEADER!r}, {WRITERS!r}\n"
        + __import__("inspect").getsource(frames_of)
    )
    done = subprocess.run([sys.executable, str(tmp_path / "run.py")], capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{os.getcwd()}"})
    assert done.returncode == 0, done.stderr[-3000:]
    assert [n for n in os.listdir(tmp_path) if n.startswith("died-")]
    found = {}
    for w in WRITERS:
        files = sorted(os.listdir(tmp_path / "j" / w), key=lambda f: int(f[:-4], 36))
        found[w] = [json.loads(f[3])["n"] for name in files for f in journal.decode_segment((tmp_path / "j" / w / name).read_bytes(), HEADER)]
    assert found == expected(400)


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    spark.dataSource.register(journal_sink.JournalSink)
    frames_of(spark, 60).repartition(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "j")

    def run(checkpoint):
        rows = spark.readStream.schema("writer string, frame string, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = rows.select("writer", "frame").writeStream.format("journal").option("header", HEADER.hex()).option("application", "s").option("checkpointLocation", checkpoint)
        out.trigger(availableNow=True).start(root).awaitTermination()

    run(str(tmp_path / "c1"))
    frames_of(spark, 40, 60).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(str(tmp_path / "c1"))
    got = stored(spark, root)
    assert {w: sorted(x) for w, x in got.items()} == expected(100)
    # A lost checkpoint replays the batches under their old numbers: nothing is added.
    run(str(tmp_path / "c2"))
    assert stored(spark, root) == got
