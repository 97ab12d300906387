"""Mixing sources to target weights under a time-varying curriculum.

Each source has a target number of words and a schedule: its weight as a piecewise linear
function of training time in [0, 1].  The integral of the schedule is the source's
cumulative demand; a document that lies at cumulative word u of its source's stream is
assigned the time at which the demand reaches u.  A source's stream is its documents in a
fixed pseudo-random order, run through again while the target lasts.  Sorting by assigned
time range by range gives the training order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._groups import SHARES
from ._scratch import Scratch

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: (time, relative weight) knots; a schedule is scaled to a mean of 1.
Schedule = Sequence[tuple[float, float]]
#: Early, level and late sources, dealt in turn like the weights.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which a schedule has used up ``share`` (0 to 1) of its demand.

    The demand is the integral of the knots' straight lines, quadratic within a segment,
    and is inverted in closed form.
    """
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    if schedule[0][0] != 0.0 or schedule[-1][0] != 1.0 or area <= 0 or any(w < 0 for _, w in schedule):
        raise ValueError("a schedule runs from 0 to 1 with weights of at least 0, not all 0")
    out, done = None, 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        w0, w1 = w0 / area, w1 / area
        part, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        if part <= 0:
            continue
        left = F.greatest(share - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + left * (2 * slope), F.lit(0.0)))
        at = F.when(left == 0, F.lit(t0)).otherwise(F.least(F.lit(t1), F.lit(t0) + left * 2 / (root + w0)))
        out = F.when(share < done + part, at) if out is None else out.when(share < done + part, at)
        done += part
    return out.otherwise(F.lit(1.0))


def _timed_by(schedule: Schedule) -> Callable[[Column], Column]:
    return lambda share: time_of(share, schedule)


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: _rank, source_size, target.

    ``sizes`` has one row per source (source, source_size).  Targets share the sum of all
    sizes by weight; a target stops at ``most`` times its source's size and the excess is
    shared again, which is the level L with sum(min(cap, L * weight)) = total, found from
    running sums over the sources in the order in which they reach their caps.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_code_point) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights) + 1)
    capped = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    stepped = capped.select(
        "*",
        F.sum("source_size").over(everything).alias("_total"),
        F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_full"),
        F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
    ).withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    # Levels rise up to the first source that they do not fill, and fall from there on.
    level = F.coalesce(F.max(fits).over(everything), F.lit(0.0))
    return stepped.withColumn("_share_level", level).select(
        "source", "_rank", "source_size", F.least(F.col("_cap").cast("double"), F.col("_share_level") * F.col("_weight")).alias("target")
    )


#: Copies of a row from which they may be placed by count instead of by a window.
COPIES = 1000


def _copied(rows: DataFrame) -> list[str]:
    """``key`` of the rows with COPIES copies at least and more than a 500th of all rows, of which there are fewer than 500."""
    total = rows.count()
    copies = rows.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") >= COPIES) & (F.col("n") * SHARES > total))
    return sorted(r.key for r in copies.collect())


def _by_count(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(buckets, rows with their place inside) of rows that have very many copies: all are made from one of each and a count.

    Each such row is a bucket of its own, behind that of its prefix; its copies are made in
    runs of COPIES, so no task makes them all.
    """
    first = [F.any_value(c).alias(c) for c in ("row", "id", "size", "src", "order", "rest", "bucket")]
    one = rows.groupBy("key").agg(F.count("*").alias("n"), *first).withColumn("bucket", F.concat_ws("/", "bucket", "order", F.col("rest").cast("string")))
    runs = one.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long")))).repartition("key", "begin")
    each = F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + COPIES, F.col("n")) - 1))
    made = runs.withColumn("copy", each).withColumn("inside", F.col("copy") * F.col("size"))
    return one.select("src", "bucket", (F.col("n") * F.col("size")).alias("words")), made.drop("key", "n", "begin", "copy")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], most: int, schedules: Sequence[Schedule], carry: Sequence[str]) -> DataFrame:
    """(row, id, size, source_size, target, positions): ``row`` is a struct of the carried columns, so no name clashes."""
    # A struct needs a field.
    row = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).alias("none"))
    picked = docs.select(
        row.alias("row"),
        F.col(id_col).alias("id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.md5(text_col), F.lit("null")).alias("text_digest"),
    )
    # Id and text decide the order; what else a row carries only parts rows equal in both.
    order = F.md5(F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("null")), "text_digest"))
    # One spelling that is never null, so that equal keys deal, join and order alike.
    rows = picked.select(
        "row", "id", "size",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"),
        order.alias("order"),
        F.xxhash64("row").alias("rest"),
    )
    rows = rows.withColumn("bucket", F.substring("order", 1, 3)).withColumn("key", F.concat_ws("/", "order", F.col("rest").cast("string"), "src"))
    copied = _copied(rows)
    others = rows.where(~F.col("key").isin(copied)) if copied else rows
    inside = Window.partitionBy("src", "bucket").orderBy("order", "rest").rowsBetween(Window.unboundedPreceding, -1)
    ordered = others.drop("key").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    buckets = others.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    if copied:
        more_buckets, more_rows = _by_count(rows.where(F.col("key").isin(copied)))
        buckets, ordered = buckets.unionByName(more_buckets), ordered.unionByName(more_rows)
    totals = buckets.groupBy("src").agg(F.sum("words").alias("source_size"))
    named = totals.select(F.when(F.col("src") != "n", F.expr("substring(src, 2)")).alias("source"), "source_size")
    targets = source_targets(named, weights, most).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src"), "_rank", "source_size", "target"
    )
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("src", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")).join(targets, "src")
    placed = ordered.join(offsets, ["src", "bucket"])
    middle = F.col("before") + F.col("inside") + F.col("size") / 2
    passes = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: middle + k * F.col("source_size")),
        lambda at: at < F.col("target"),
    )
    timed = F.lit(None).cast("array<double>")
    shares = F.transform(passes, lambda at: at / F.col("target"))
    for i, schedule in enumerate(schedules):
        times = F.transform(shares, _timed_by(schedule))
        timed = F.when(F.col("_rank") % len(schedules) == i, times).otherwise(timed)
    return placed.select("row", "id", "size", "source_size", "target", timed.alias("positions"), "order", "rest")


def mix_to_targets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken, positions.

    size is the number of words (null text: 0).  positions (array<double>, at most ``most``)
    holds the training time of every pass through the document, and taken is size times
    their number.  Pass k of a document that starts at word c of its source's stream is
    taken if its middle lies before the target, so a source's taken words miss its target
    by half a document at most.  The stream's order is by md5 of id and text digest; rows
    equal in both, and in what they carry, are interchangeable, so reruns agree.  Null sources are one source, null ids one id.  Only id, text and
    source are read, so other columns may have any names.

    A source is summed in 4,096 buckets of the order and numbered inside each, and copies of
    one row are placed by their count, so neither a source nor a row with most of the rows,
    nor rows without an id, are ordered in one task; only one row per source meets in one.
    """
    placed = _placed(docs, id_col, text_col, source_col, weights, most, schedules, ())
    taken = (F.col("size") * F.size("positions")).alias("taken")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "positions")


def training_order(
    docs: DataFrame,
    partitions: int | None = None,
    *,
    position_col: str = "_position",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """The rows of ``docs``, once for every pass taken, range-partitioned and sorted by time.

    The columns are those of ``docs``, whatever their names, and the position; a column of
    the position's name is replaced.
    """
    columns = [c for c in docs.columns if c.lower() != position_col.lower()]
    placed = _placed(docs, id_col, text_col, source_col, weights, most, schedules, columns)
    passes = placed.select("row", "order", "rest", F.explode("positions").alias("position"))
    keys = ["position", "order", "rest"]
    dealt = passes.repartitionByRange(partitions, *keys) if partitions else passes.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).select("row.*", F.col("position").alias(position_col))


def with_ranks(docs: DataFrame, ranges: int = 4096, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of ``mix_to_targets`` and ranks (array<long>): each pass's rank from 0 in the training order.

    The order is that of ``training_order``, equal rows tied.  Passes are dealt to equal
    ranges of time, counted by range and numbered inside each, so that only one row per
    range meets in one task.  Schedules bound the words that fall into a range.  The rows
    are written once, so their keys stand.  Rows without a pass have no ranks.
    """
    id_col = options.get("id_col", "doc_id")
    mixed = mix_to_targets(docs, **options).withColumn("_row", F.monotonically_increasing_id())
    rows = (scratch or Scratch(docs.sparkSession, "mixing")).keep(mixed)
    at = F.least(F.floor(F.col("_position") * ranges), F.lit(ranges - 1))
    passes = rows.select("_row", F.col(id_col).alias("_id"), F.posexplode("positions").alias("_pass", "_position")).withColumn("_range", at)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = passes.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy("_range").orderBy("_position", "_id", "_row", "_pass")
    ranked = passes.withColumn("_at", F.row_number().over(inside) - 1).join(begins, "_range")
    ranks = ranked.groupBy("_row").agg(F.sort_array(F.collect_list(F.col("_begin") + F.col("_at"))).alias("ranks"))
    none = F.array().cast("array<bigint>")
    return rows.join(ranks, "_row", "left").withColumn("ranks", F.coalesce("ranks", none)).drop("_row")
