"""Clocks kept by timers against their batch form, over replays in different orders and batches, with restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stateloom.streaming import clocks

START = datetime(2024, 1, 1)
END = START + timedelta(hours=3)


@pytest.fixture
def rocks(spark):
    for k, v in clocks.needed_settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in clocks.needed_settings:
        spark.conf.unset(k)


def replayed(spark, tmp_path, rows, schema, stream, seed, restarts=1):
    """What the stream gives out in all, from rows shuffled within a minute's delay, dealt to several batches."""
    rng = random.Random(seed)
    arrival = sorted(rows, key=lambda r: r[-1] + timedelta(seconds=rng.random() * 50))
    folder, out = tmp_path / f"in{seed}", str(tmp_path / f"out{seed}")
    size = max(1, len(arrival) // 4)
    parts = [arrival[i : i + size] for i in range(0, len(arrival), size)]
    # The last row pushes the watermark past everything; two batches let its timers fire.
    parts += [[(*[type(v)(9999) if isinstance(v, int) and not isinstance(v, bool) else v for v in rows[0][:-1]], END + timedelta(minutes=1, seconds=k))] for k in range(2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if k % (len(parts) // (restarts + 1)) == 0 or k >= len(parts) - 2:
            read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
            query = stream(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"c{seed}"))
            query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def rows_of(df, keep):
    return sorted(tuple(r) for r in df.collect() if keep(r))


def observations(seed):
    """Passes over waiting jobs: a child unresolved for a while, resolved, or replaced by another."""
    rng, rows = random.Random(seed), []
    for job in range(12):
        at = START + timedelta(seconds=rng.randrange(60))
        while at < END - timedelta(minutes=20):
            child = rng.choice("abc")
            for _ in range(rng.randint(1, 6)):
                rows.append((job, child, False, at))
                at += timedelta(seconds=rng.choice([20, 70, 150]))
            if rng.random() < 0.5:
                rows.append((job, rng.choice([child, child, "z"]), True, at))
            at += timedelta(seconds=rng.choice([10, 300, 900]))
    return rows + rows[::17]


SEEN = "job_id long, child string, resolved boolean, at timestamp"


def test_grace_equals_its_batch_form(rocks, tmp_path):
    rows = observations(3)
    stream = lambda df: clocks.join_grace(df, 300, "60 seconds")
    want = rows_of(clocks.join_grace_of(rocks.createDataFrame(rows, SEEN), 300, F.lit(END)), lambda r: True)
    assert len(want) > 20
    for seed in (1, 2):
        assert rows_of(replayed(rocks, tmp_path, rows, SEEN, stream, seed), lambda r: r.job_id != 9999) == want


def test_another_child_resets_the_clock(rocks):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, "a", False, at(0)), (1, "a", False, at(90)), (1, "b", False, at(95)), (1, "b", False, at(190)), (1, "b", True, at(194)),
            (2, "a", False, at(0)), (2, "z", True, at(50)), (2, "a", False, at(99)), (3, "a", False, at(0)), (3, "a", True, at(10)), (3, "a", False, at(20)),
            (4, "a", False, at(0)), (4, "b", False, at(150)), (4, "a", False, at(160))]
    made = clocks.join_grace_of(rocks.createDataFrame(rows, SEEN), 100, F.lit(at(200))).collect()
    assert sorted((r.job_id, r.child, r.first_unresolved_at) for r in made) == [(2, "a", at(0)), (3, "a", at(20)), (4, "a", at(0))]


def test_silence_equals_its_batch_form(rocks, tmp_path):
    rng, rows = random.Random(5), []
    for s in range(10):
        at, generation = START + timedelta(seconds=s), 0
        while at < END - timedelta(minutes=20):
            rows.append((f"s{s}", f"g{generation}", at))
            at += timedelta(seconds=rng.choice([5, 30, 200, 700]))
            generation += rng.random() < 0.2
    schema = "source string, generation string, at timestamp"
    stream = lambda df: clocks.source_silence(df.withColumn("source", F.when(F.col("at") > F.lit(END), "end").otherwise(F.col("source"))), 180, "60 seconds")
    want = rows_of(clocks.source_silence_of(rocks.createDataFrame(rows, schema), 180, F.lit(END)), lambda r: True)
    assert {v for _, v, _ in want} == {"silent", "reopened", "rotated"}
    assert rows_of(replayed(rocks, tmp_path, rows, schema, stream, 1), lambda r: r.source != "end") == want
