"""Hard negatives by a pivot table over augmented vectors.

With one coordinate more, every row gets the same length: a row v becomes (v, sqrt(M - |v|^2)),
M the largest squared length, and an anchor q becomes (q, 0).  Then |q - v|^2 = |q|^2 + M - 2 q.v,
so the largest inner products are the least Euclidean distances.  A table holds each row's
distances to some pivots.  By the triangle inequality |d(q,p) - d(v,p)| <= d(q,v) <= d(q,p) + d(v,p)
for every pivot p, which brackets q.v without looking at v; only rows whose bracket reaches
what is asked for are checked exactly, in integers.

Rows lie in the cell of their nearest pivot, and a cell's least and largest distances to
every pivot bracket all of its rows at once, so an anchor visits only cells that its bracket
does not rule out.  A visited cell meets its anchors block by block: blocks of rows and of
anchors are bounded, whatever the sizes of cells and labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._groups import complete, dealt
from ._scratch import Scratch
from .embeddings import rows_of

#: A squared length from which scores need not fit a long.
TOO_LONG = float(1 << 62)
#: Pairs whose brackets are in memory at once.
PAIRS = 1 << 20


def quantised(vectors: DataFrame, anchor: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, anchor, q, size, norm): rows that take part; q holds floor(scale * x) as packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = rows_of(batch.column(3))
            lengths, n = np.diff(at), batch.num_rows
            keep, norms = np.zeros(n, bool), np.zeros(n, np.int64)
            packed: list[bytes | None] = [None] * n
            for size in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == size)
                with np.errstate(invalid="ignore", over="ignore"):
                    x = np.floor(scale * flat[at[rows][:, None] + np.arange(size)])
                    good = (np.isfinite(x).all(axis=1)) & ((x * x).sum(axis=1) < TOO_LONG)
                rows, x = rows[good], x[good].astype(np.int64)
                keep[rows] = True
                norms[rows] = (x * x).sum(axis=1)
                for row, q in zip(rows.tolist(), x.astype("<i4")):
                    packed[row] = q.tobytes()
            made = [pa.array(packed, pa.binary()), pa.array(lengths, pa.int32()), pa.array(norms)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["id", "label", "anchor", "q", "size", "norm"])
            yield out.filter(pa.array(keep))

    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("vec"))
    kind = named.schema["id"].dataType.simpleString()
    able = named.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    return able.mapInArrow(run, f"id {kind}, label long, anchor boolean, q binary, size int, norm long")


class Pivots(NamedTuple):
    """Pivots in augmented space: coordinates (padded with zeros), the coordinate more, and M."""

    x: np.ndarray
    more: np.ndarray
    most: float

    def slack(self, size: int) -> float:
        """More than a distance can be wrong by: the root of what rounding does to its square."""
        return math.sqrt(self.most * 1e-14 * (size + 16)) + 1e-9

    def distances(self, x: np.ndarray, norm: np.ndarray, is_anchor: bool) -> np.ndarray:
        """Distances of rows (or anchors) of one length to all pivots; a pivot is cut or padded to that length."""
        size = x.shape[1]
        p = np.zeros((len(self.x), size))
        width = min(size, self.x.shape[1])
        p[:, :width] = self.x[:, :width]
        norm = norm.astype(np.float64)
        square = norm[:, None] + (p * p).sum(axis=1) + self.more**2 - 2 * (x.astype(np.float64) @ p.T)
        if not is_anchor:
            more = np.sqrt(np.maximum(self.most - norm, 0))
            square += (more * more)[:, None] - 2 * more[:, None] * self.more
        return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: list[tuple[bytes, int]], most: int, n: int) -> Pivots:
    """Up to n rows of the sample, each the farthest from those before it."""
    width = max((len(q) // 4 for q, _ in sample), default=0)
    x = np.zeros((len(sample), width))
    for i, (q, _) in enumerate(sample):
        x[i, : len(q) // 4] = np.frombuffer(q, "<i4")
    more = np.sqrt(np.maximum(float(most) - np.array([m for _, m in sample], np.float64), 0))
    whole = np.column_stack([x, more])
    chosen = [0]
    nearest = ((whole - whole[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
    return Pivots(x[chosen], more[chosen], float(most))


class Zones(NamedTuple):
    """Rows of each cell, and the least and largest distance of its rows to each pivot."""

    rows: np.ndarray
    least: np.ndarray
    largest: np.ndarray


def _matrix(packed: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def by_length(batch: pa.RecordBatch, q: str, size: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a batch."""
    sizes = batch.column(size).to_numpy()
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield rows, _matrix(batch.column(q).take(pa.array(rows)), width) if width else np.zeros((len(rows), 0), np.int64)


def pivot_table(base: DataFrame, pivots: Pivots) -> DataFrame:
    """``base`` with each row's distances to the pivots and its cell, the nearest pivot."""
    schema = base.withColumn("dist", F.array().cast("array<double>")).withColumn("cell", F.lit(0)).schema
    n = len(pivots.more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, n))
            norm = batch.column("norm").to_numpy()
            for rows, x in by_length(batch, "q", "size"):
                out[rows] = pivots.distances(x, norm[rows], False)
            dist = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.ravel()))
            cell = pa.array(out.argmin(axis=1) if len(out) else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, dist, cell], names=schema.names)

    return base.mapInArrow(run, schema)


def zones_of(table: DataFrame, n: int) -> Zones:
    """One row per cell, of which there are no more than pivots."""
    ends = [f(F.get("dist", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(n)]
    rows, least, largest = np.zeros(n, np.int64), np.full((n, n), np.inf), np.full((n, n), -np.inf)
    for r in table.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect():
        rows[r.cell] = r.n
        least[r.cell], largest[r.cell] = r[2 : 2 + n], r[2 + n :]
    return Zones(rows, least, largest)


def brackets(square: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) possible scores from bounds of the distances; ``square`` is |q|^2 + M."""
    spare = 1 + 1e-12 * square
    return (square - farthest**2) / 2 - spare, (square - nearest**2) / 2 + spare


def visits(anchors: DataFrame, pivots: Pivots, zones: Zones, others_only: bool) -> DataFrame:
    """``anchors`` once for each cell whose bracket meets what the anchor asks for.

    ``anchors``: the columns of the pivot table, low and high (doubles: scores asked for).
    ``others_only`` leaves the anchor's own cell out.
    """
    names = ["cell", "row", "id", "label", "q", "size", "norm", "low", "high", "scores"]
    schema = anchors.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            meets = np.zeros((n, len(zones.rows)), bool)
            norm, low, high = (batch.column(c).to_numpy() for c in ("norm", "low", "high"))
            for rows, x in by_length(batch, "q", "size"):
                dq, e = pivots.distances(x, norm[rows], True)[:, None, :], 2 * pivots.slack(x.shape[1])
                near = np.maximum(np.maximum(zones.least - dq, dq - zones.largest).max(axis=2) - e, 0)
                far = (dq + zones.largest).min(axis=2) + e
                least, largest = brackets((norm[rows] + pivots.most)[:, None], near, far)
                meets[rows] = (largest >= low[rows, None]) & (least <= high[rows, None]) & (zones.rows > 0)
            if others_only:
                meets[np.arange(n), batch.column("cell").to_numpy()] = False
            at, cell = np.nonzero(meets)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *[taken.column(c) for c in names[1:]]], names=names)

    return anchors.select(*names).mapInArrow(run, schema)


def exact_scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows i of a with the rows j of b, in integers.

    Doubles hold them exactly where no sum can reach 2**53; sums of longs come out right,
    since the results fit and wrapping is undone by the same wrap.
    """
    width = a.shape[1]
    if not width or not len(i):
        return np.zeros(len(i), np.int64)
    small = width * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53
    if small and 8 * len(i) > len(a) * len(b):
        return (a.astype(np.float64) @ b.astype(np.float64).T)[i, j].astype(np.int64)
    out, step = np.zeros(len(i), np.int64), max(1, PAIRS // width)
    for k in range(0, len(i), step):
        out[k : k + step] = (a[i[k : k + step]] * b[j[k : k + step]]).sum(axis=1)
    return out


class Block(NamedTuple):
    """Anchors or rows of one group and one vector length."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    dist: np.ndarray
    norm: np.ndarray


def _bounds(a: Block, b: Block, pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """Brackets of the scores of all anchors of a with all rows of b."""
    e = 2 * pivots.slack(a.x.shape[1])
    near, far = np.zeros((len(a.row), len(b.row))), np.full((len(a.row), len(b.row)), np.inf)
    for p in range(a.dist.shape[1]):
        one, two = a.dist[:, p, None], b.dist[None, :, p]
        np.maximum(near, np.abs(one - two), out=near)
        np.minimum(far, one + two, out=far)
    return brackets((a.norm + pivots.most)[:, None], np.maximum(near - e, 0), far + e)


def alike(a: Block, b: Block, low: np.ndarray, k: int, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score): the first k rows of each anchor's label, among those of at least ``low``."""
    out = []
    for label in np.unique(a.label).tolist():
        mine, rows = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        if not len(rows):
            continue
        one, two = (Block(*(f[i] for f in block)) for block, i in ((a, mine), (b, rows)))
        largest = _bounds(one, two, pivots)[1]
        largest[one.row[:, None] == two.row[None, :]] = -np.inf
        floor = low[mine].copy()
        if len(rows) > 4 * k:
            # The rows of the best brackets, checked first, raise what the others have to reach.
            best = np.argpartition(-largest, 2 * k, axis=1)[:, : 2 * k]
            i = np.repeat(np.arange(len(mine)), 2 * k)
            first = exact_scores(one.x, two.x, i, best.ravel()).astype(np.float64).reshape(len(mine), -1)
            first[np.isneginf(np.take_along_axis(largest, best, axis=1))] = -np.inf
            floor = np.maximum(floor, -np.partition(-first, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((largest >= floor[:, None]) & ~np.isneginf(largest))
        score = exact_scores(one.x, two.x, i, j)
        order = np.lexsort((two.row[j], two.id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out.append((mine[i[keep]], rows[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score, as inclusive limits."""
    return -(-low * score // 100), high * score // 100


def unlike(a: Block, b: Block, scores: list[list[int]], k: int, low: int, high: int, pivots: Pivots) -> list[tuple[int, int, int, int]]:
    """(anchor, positive's place, row, score): the first k rows of other labels in each positive's window."""
    windows = [[window_of(s, low, high) for s in each] for each in scores]
    asked = [[w for w in each if w[0] <= w[1]] for each in windows]
    floor = np.array([min((lo for lo, _ in w), default=np.inf) for w in asked], np.float64)
    roof = np.array([max((hi for _, hi in w), default=-np.inf) for w in asked], np.float64)
    least, largest = _bounds(a, b, pivots)
    i, j = np.nonzero((largest >= floor[:, None]) & (least <= roof[:, None]) & (a.label[:, None] != b.label[None, :]))
    score = exact_scores(a.x, b.x, i, j)
    order = np.lexsort((b.row[j], b.id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    begins, out = np.searchsorted(i, np.arange(len(a.row) + 1)).tolist(), []
    for n, each in enumerate(windows):
        down = -score[begins[n] : begins[n + 1]]
        for place, (lo, hi) in enumerate(each):
            first, last = int(np.searchsorted(down, -hi)), int(np.searchsorted(down, -lo, side="right"))
            for at in range(first, min(last, first + k)):
                out.append((n, place, int(j[begins[n] + at]), -int(down[at])))
    return out


def met(table: DataFrame, asking: DataFrame, zones: Zones, pivots: Pivots, k: int, block: int, anchor_block: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor, place, other, id, score): what each anchor finds in the blocks of the cells that it visits.

    ``asking`` is from ``visits``.  Without a window, rows of the anchor's label (place 0);
    with one, rows of other labels in the window of each positive.
    """
    asked = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}  # one row per cell
    cells = len(zones.rows)
    n_rows = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // block))) for n in zones.rows]), F.col("cell") + 1)
    n_asking = F.element_at(F.array(*[F.lit(-(-asked.get(c, 0) // anchor_block)) for c in range(cells)]), F.col("cell") + 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("_other")
    part = lambda n: F.pmod(F.xxhash64("row"), n).cast("long").alias("_own")
    kind = table.schema["id"].dataType.simpleString()
    none = {"dist": F.lit(None).cast("array<double>"), "low": F.lit(None).cast("double"), "scores": F.lit(None).cast("array<bigint>")}
    fields = ["key", "_pair", "row", "id", "label", "q", "size", "norm", "dist", "low", "scores"]
    pair = lambda sub, anchors, side: F.shiftleft(sub.cast("long"), 32) + F.shiftleft(anchors.cast("long"), 1) + F.lit(side)
    held = table.where(n_asking > 0).select("*", part(n_rows), spread(n_asking)).select(
        F.col("cell").cast("long").alias("key"), pair(F.col("_own"), F.col("_other"), 1).alias("_pair"), "row", "id", "label", "q", "size", "norm", "dist", none["low"].alias("low"), none["scores"].alias("scores")
    )
    ask = asking.select("*", part(n_asking), spread(n_rows)).select(
        F.col("cell").cast("long").alias("key"), pair(F.col("_other"), F.col("_own"), 0).alias("_pair"), "row", "id", "label", "q", "size", "norm", none["dist"].alias("dist"), "low", "scores"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in complete(batches):
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                group = batch.slice(begin, end - begin)
                side = group.column("_pair").to_numpy() & 1
                split = int(np.searchsorted(side, 1))
                if not 0 < split < len(side):
                    continue
                asking, rows = group.slice(0, split), group.slice(split)
                stored = {m.shape[1]: (at, m) for at, m in by_length(rows, "q", "size")}
                for at, x in by_length(asking, "q", "size"):
                    if x.shape[1] not in stored:
                        continue
                    there, y = stored[x.shape[1]]
                    values = lambda g, c, i: g.column(c).take(pa.array(i)).to_numpy(zero_copy_only=False)
                    of = lambda g, i, m, d: Block(values(g, "row", i), values(g, "id", i), values(g, "label", i), m, d, values(g, "norm", i))
                    dist = rows.column("dist").take(pa.array(there)).flatten().to_numpy().reshape(len(there), -1)
                    two = of(rows, there, y, dist)
                    step = max(1, PAIRS // len(there))
                    for k0 in range(0, len(at), step):
                        i = at[k0 : k0 + step]
                        m = x[k0 : k0 + step]
                        one = of(asking, i, m, pivots.distances(m, values(asking, "norm", i), True))
                        if window is None:
                            a, b, score = alike(one, two, values(asking, "low", i), k, pivots)
                            place = np.zeros(len(a), np.int32)
                        else:
                            scores = asking.column("scores").take(pa.array(i)).to_pylist()
                            found = unlike(one, two, scores, k, *window, pivots)
                            a, place, b, score = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
                        ids = rows.column("id").take(pa.array(there[b]))
                        made = [pa.array(one.row[a]), pa.array(place, pa.int32()), pa.array(two.row[b]), ids, pa.array(score, pa.int64())]
                        yield pa.RecordBatch.from_arrays(made, names=["anchor", "place", "other", "id", "score"])

    both = dealt(ask.select(*fields).unionByName(held.select(*fields)), "key")
    return both.mapInArrow(run, f"anchor long, place int, other long, id {kind}, score long")


def firsts(found: DataFrame, k: int) -> DataFrame:
    """The first k finds of each anchor and place, numbered by ``rank``; each task drops what k others there precede."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    n_pivots: int = 16,
    sample: int = 2048,
    block: int = 8192,
    anchor_block: int = 1024,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the
    anchor.  ``anchor`` marks the anchors.  An anchor's positives are its first
    ``n_positives`` other rows of its label, by score from the highest, then id.  The
    negatives of an anchor and a positive are the first ``n_negatives`` rows of other labels
    with low * positive <= 100 * negative <= high * positive, ranked from 1 in that order.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part, nor do rows so long (2**31 after scaling) that scores leave the range of a long.
    Vectors of different lengths are never compared; empty ones score 0.  Rows that repeat
    an id are rows of their own.  Labels are integers.  Other columns are not read.

    Pivots are chosen from the ``sample`` rows of least hash of the id; every row is in the
    table, and results are exact whatever the pivots.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "pivots")
    base = scratch.keep(quantised(vectors, anchor, id_col, vec_col, label_col, scale).withColumn("row", F.monotonically_increasing_id()))
    id_kind = base.schema["id"].dataType.simpleString()
    largest = base.agg(F.max("norm").alias("norm"), F.max("size").alias("size")).first()
    if largest.norm is None:
        return spark.createDataFrame([], f"anchor_id {id_kind}, positive_id {id_kind}, rank int, negative_id {id_kind}, positive_score long, negative_score long")
    drawn = base.select(F.xxhash64("id").alias("h"), "row", "q", "norm").orderBy("h", "row").limit(sample).collect()
    pivots = choose_pivots([(bytes(r.q), r.norm) for r in drawn], largest.norm, n_pivots)
    table = scratch.keep(pivot_table(base, pivots))
    zones = zones_of(table, len(pivots.more))
    block = max(64, min(block, (32 << 20) // (8 * max(1, largest.size))))
    blocks = dict(zones=zones, pivots=pivots, block=block, anchor_block=anchor_block)

    # Positives: the anchor's own cell first, then the cells that may hold better ones.
    no_scores = F.lit(None).cast("array<bigint>").alias("scores")
    anchors = table.where("anchor").drop("anchor")
    first = anchors.select("*", F.lit(-math.inf).alias("low"), F.lit(math.inf).alias("high"), no_scores)
    own = scratch.keep(firsts(met(table, first, k=n_positives, window=None, **blocks), n_positives))
    floor = own.groupBy("anchor").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") >= n_positives)
    more = anchors.join(floor, anchors["row"] == floor["anchor"], "left").select(
        anchors["*"], F.coalesce(F.col("_least").cast("double"), F.lit(-math.inf)).alias("low"), F.lit(math.inf).alias("high"), no_scores
    )
    asking = scratch.keep(visits(more, pivots, zones, True))
    rest = met(table, asking, k=n_positives, window=None, **blocks)
    best = firsts(own.drop("rank").unionByName(rest), n_positives)
    listed = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    positives = scratch.keep(listed.select("anchor", F.transform("p", lambda x: x["id"]).alias("positives"), F.transform("p", lambda x: x["score"]).alias("scores")))

    # Negatives: the cells whose brackets meet a positive's window; a negative score has none.
    usable = F.filter("scores", lambda s: s >= 0)
    with_windows = anchors.join(positives, anchors["row"] == positives["anchor"]).where(F.size(usable) > 0).select(
        anchors["*"], (F.array_min(usable) * (low / 100) - 1).cast("double").alias("low"), (F.array_max(usable) * (high / 100) + 1).cast("double").alias("high"), "scores"
    )
    asking = scratch.keep(visits(with_windows, pivots, zones, False))
    found = firsts(met(table, asking, k=n_negatives, window=(low, high), **blocks), n_negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    at = F.col("place") + 1
    return found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, "anchor").join(names, "anchor").select(
        "anchor_id", F.element_at("positives", at).alias("positive_id"), "rank", "negative_id", F.element_at("scores", at).alias("positive_score"), "negative_score"
    )
