"""Clocks that streams keep: the grace of a join whose child cannot be resolved, and sources that fall silent.

Both keep their state per key in ``transformWithState`` and act by timers of event time, so a
deadline fires when the watermark passes it, also where nothing more arrives for the key, and
a restarted query finds its clocks where they were.  The batch functions beside them say what
the streams come to, whatever the order of arrival within the watermark's delay.

The session needs the RocksDB state store (``needed_settings``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

needed_settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
GRACE_OUTPUT = "job_id long, child string, first_unresolved_at timestamp, verdict string, decided_at timestamp"
SILENCE_OUTPUT = "source string, verdict string, at timestamp"


def _micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Ordered(StatefulProcessor):
    """Events of a key applied in order of event time, once the watermark has passed them.

    Arrivals wait in a map state under (time, name); a timer at each one's time applies what
    is due.  A repeated event falls on the first, so it is applied once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, child string", "resolved boolean")

    def hold(self, at: int, child: str, resolved: bool) -> None:
        """Of two observations of one child at one moment, the one that resolves it counts."""
        place = (at, child)
        if not self.waiting.containsKey(place) or (resolved and not self.waiting.getValue(place)[0]):
            self.waiting.updateValue(place, (resolved,))

    def due(self, watermark: int) -> list[tuple[int, str, bool]]:
        """What lies at or before the watermark (in milliseconds), in order; it is taken out."""
        ready = sorted((at, child, value[0]) for (at, child), value in self.waiting.iterator() if at // 1000 <= watermark)
        for at, child, _ in ready:
            self.waiting.removeKey((at, child))
        return ready

    def close(self) -> None:
        pass


class GraceClock(_Ordered):
    """Per job: since when the child that holds up its join has been unresolved."""

    def __init__(self, grace_seconds: float):
        self.grace = int(grace_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", "child string, first long, decided boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, child, resolved in zip(_micros(batch["at"]), batch["child"], batch["resolved"], strict=True):
                self.hold(at, child, bool(resolved))
                # Timers count whole milliseconds; one due already fires in the next batch.
                self.handle.registerTimer(max(at // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        out = []
        for at, child, resolved in self.due(watermark):
            self.passed(key[0], at, out)
            held = self.clock.get()
            if resolved:
                # Only the child on the clock can stop it.
                if held is not None and held[0] == child:
                    self.clock.clear()
            elif held is None or held[0] != child:
                # Another child starts the clock anew, whatever had been decided.
                self.clock.update((child, at, False))
                self.handle.registerTimer((at + self.grace) // 1000 + 1)
        self.passed(key[0], 1000 * watermark, out)
        yield pd.DataFrame(out, columns=["job_id", "child", "first_unresolved_at", "verdict", "decided_at"])

    def passed(self, job: int, now: int, out: list) -> None:
        """Decides the clock's child once its grace has run out by ``now``."""
        held = self.clock.get()
        if held is not None and not held[2] and now >= held[1] + self.grace:
            out.append((job, held[0], _stamp(held[1]), "join_unresolvable", _stamp(held[1] + self.grace)))
            self.clock.update((held[0], held[1], True))


class SilenceClock(_Ordered):
    """Per source: when it last spoke; silent after the timeout, open again once it speaks (as after a rotation)."""

    def __init__(self, timeout_seconds: float):
        self.timeout = int(timeout_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, generation string, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, generation in zip(_micros(batch["at"]), batch["generation"], strict=True):
                self.hold(at, generation, True)
                self.handle.registerTimer(max(at // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        out = []
        for at, generation, _ in self.due(watermark):
            self.passed(key[0], at, out)
            held = self.last.get()
            if held is not None and held[2]:
                out.append((key[0], "reopened", _stamp(at)))
            elif held is not None and held[1] != generation:
                out.append((key[0], "rotated", _stamp(at)))
            self.last.update((at, generation, False))
            self.handle.registerTimer((at + self.timeout) // 1000 + 1)
        self.passed(key[0], 1000 * watermark, out)
        yield pd.DataFrame(out, columns=["source", "verdict", "at"])

    def passed(self, source: str, now: int, out: list) -> None:
        held = self.last.get()
        if held is not None and not held[2] and now >= held[0] + self.timeout:
            out.append((source, "silent", _stamp(held[0] + self.timeout)))
            self.last.update((held[0], held[1], True))


def join_grace(observed: DataFrame, grace_seconds: float, delay: str = "10 seconds") -> DataFrame:
    """Joins given up because a child stayed unresolved for the grace: GRACE_OUTPUT, as a stream.

    ``observed``: job_id, child, resolved, at: what a pass over a waiting job saw, with one
    unresolved child at most.  The clock runs from the first sight of the child; the same
    child resolved stops it, another child starts it anew.  Rows later than ``delay`` are
    dropped, as a watermark does.
    """
    rows = observed.select("job_id", "child", "resolved", "at").withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(GraceClock(grace_seconds), GRACE_OUTPUT, "append", "eventTime")


def source_silence(lines: DataFrame, timeout_seconds: float, delay: str = "10 seconds") -> DataFrame:
    """Sources that fall silent, speak again or are rotated: SILENCE_OUTPUT, as a stream.

    ``lines``: source, generation (of the file behind it), at.
    """
    rows = lines.select("source", "generation", "at").withWatermark("at", delay)
    return rows.groupBy("source").transformWithStateInPandas(SilenceClock(timeout_seconds), SILENCE_OUTPUT, "append", "eventTime")


def join_grace_of(observed: DataFrame, grace_seconds: float, now: Column) -> DataFrame:
    """What ``join_grace`` has given out once the watermark is at ``now``, from all rows at once.

    Runs of one unresolved child, from its first sight to the next row that stops or replaces
    it, are found with windows; those that last for the grace are given up.
    """
    rows = observed.groupBy("job_id", "at", "child").agg(F.bool_or("resolved").alias("resolved")).where(F.col("at") <= now)
    order = Window.partitionBy("job_id").orderBy("at", "child")
    # The child on the clock is that of the last unresolved row, unless a row since then resolved it.
    unresolved = F.last(F.when(~F.col("resolved"), F.col("child")), ignorenulls=True)
    before = unresolved.over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_before", before).withColumn("_stops", F.col("resolved") & (F.col("child") == F.col("_before")))
    # A row that resolves another child changes nothing.
    kept = marked.where(~F.col("resolved") | F.col("_stops"))
    again = F.lag("_stops").over(order)
    starts = ~F.col("resolved") & (F.col("_before").isNull() | (F.col("_before") != F.col("child")) | F.coalesce(again, F.lit(False)))
    runs = kept.withColumn("_run", F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edges = runs.groupBy("job_id", "_run").agg(
        F.min_by("child", F.struct("at", "child")).alias("child"), F.min("at").alias("first_unresolved_at"), F.min(F.when(F.col("_stops"), F.col("at"))).alias("_stopped")
    ).where("_run > 0")
    following = F.lead("first_unresolved_at").over(Window.partitionBy("job_id").orderBy("_run"))
    grace = F.make_dt_interval(secs=F.lit(float(grace_seconds)))
    decided = edges.withColumn("_next", following).withColumn("decided_at", F.col("first_unresolved_at") + grace)
    until = F.least(F.coalesce("_stopped", now), F.coalesce("_next", now), now)
    lasting = decided.where(F.col("decided_at") <= until)
    return lasting.select("job_id", "child", "first_unresolved_at", F.lit("join_unresolvable").alias("verdict"), "decided_at")


def source_silence_of(lines: DataFrame, timeout_seconds: float, now: Column) -> DataFrame:
    """What ``source_silence`` has given out once the watermark is at ``now``, from all rows at once."""
    rows = lines.select("source", "generation", "at").distinct().where(F.col("at") <= now)
    order = Window.partitionBy("source").orderBy("at", "generation")
    timeout = F.make_dt_interval(secs=F.lit(float(timeout_seconds)))
    near = rows.select("*", F.lag("at").over(order).alias("_last"), F.lag("generation").over(order).alias("_generation"), F.lead("at").over(order).alias("_next"))
    silent = near.where(F.coalesce("_next", now) >= F.col("at") + timeout).select("source", F.lit("silent").alias("verdict"), (F.col("at") + timeout).alias("at"))
    back = F.col("at") >= F.col("_last") + timeout
    other = F.when(back, "reopened").when(F.col("generation") != F.col("_generation"), "rotated")
    return silent.unionByName(near.select("source", other.alias("verdict"), "at").where("verdict IS NOT NULL"))
