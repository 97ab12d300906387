"""Live progression of jobs: a keyed state machine over a stream of frames.

The state of a job is its last accepted generation, kind and counters.  Frames are accepted
in order of generation and once each, so replays and retried batches change nothing; the
final state equals the batch fold of the same frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "job_id long, generation long, kind string, n_claims long, n_failures long, expired boolean"
STATE = "generation long, kind string, n_claims long, n_failures long"


def progressed(frames: DataFrame, lease_ms: int | None = None) -> DataFrame:
    """The state of each job after every micro-batch that touches it.

    With a lease, a job silent for that long in processing time is reported expired once.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, kind, claims, failures = state.get if state.exists else (0, "submitted", 0, 0)
        expired = state.hasTimedOut
        if not expired:
            rows = sorted((int(g), k) for b in batches for g, k in zip(b["generation"], b["kind"], strict=True))
            for g, k in rows:
                if g > generation:
                    generation, kind = g, k
                    claims += k == "claimed"
                    failures += k == "failed"
        # Written after a timeout too, which clears it: a job is reported once per silence.
        state.update((generation, kind, claims, failures))
        if lease_ms and not expired:
            state.setTimeoutDuration(lease_ms)
        yield pd.DataFrame([(key[0], generation, kind, claims, failures, expired)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if lease_ms else GroupStateTimeout.NoTimeout
    return frames.select("job_id", "generation", "kind").groupBy("job_id").applyInPandasWithState(step, OUTPUT, STATE, "update", timeout)


def batch_state(frames: DataFrame) -> DataFrame:
    """The same final state by aggregation."""
    return frames.groupBy("job_id").agg(
        F.max("generation").alias("generation"),
        F.max_by("kind", "generation").alias("kind"),
        F.count_if(F.col("kind") == "claimed").alias("n_claims"),
        F.count_if(F.col("kind") == "failed").alias("n_failures"),
    )


def replay(spark: SparkSession, folder: str, schema, checkpoint: str, files_per_batch: int = 1, most_batches: int | None = None) -> DataFrame:
    """Streams a folder of frame files to the end and returns the last state of every job.

    States go to a table by ``foreachBatch``, keyed by batch, so a batch that is run again
    overwrites itself.  Every batch costs a report of each state partition to the driver, so
    with ``most_batches`` a batch takes as many files as keep to that number of batches.
    """
    out = f"{checkpoint}/states"
    if most_batches:
        n_files = len(spark.read.schema(schema).parquet(folder).inputFiles())
        files_per_batch = max(files_per_batch, -(-n_files // most_batches))
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = progressed(frames).writeStream.outputMode("update").option("checkpointLocation", f"{checkpoint}/log").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(out)
    return states.groupBy("job_id").agg(F.max_by(F.struct("generation", "kind", "n_claims", "n_failures"), F.struct("generation", "batch")).alias("s")).select("job_id", "s.*")
