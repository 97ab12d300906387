"""Near-duplicate vectors by random-hyperplane signs, exact cosines and components.

In each of several tables a vector's code is the signs of its products with ``bits`` random
hyperplanes; vectors with equal codes in a table share a bucket.  Equal vectors are one
class, a numbered node.  Buckets are searched twice, block by block inside tasks:

1. Only nodes and signatures are dealt to the buckets.  A pair is a candidate if its
   signatures differ in no more signs than a pair at the threshold may, and in the first
   table that it shares.  What comes out is the nodes with a candidate, never pairs.
2. The vectors of those nodes are dealt to the same buckets, and candidates' cosines are
   computed in double precision.  Each vector's number of links comes out, and at most one
   link per vector and pair of blocks, which is enough for the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import dealt, forest, in_block_pairs, runs, salted_join
from ._scratch import Scratch
from .components import connected_components

#: Signs that travel with a node to its buckets.
SEARCH_BITS = 256


def tables_for(n: int, threshold: float, miss: float, per_bucket: int) -> tuple[int, int]:
    """(bits, tables): about ``per_bucket`` unrelated vectors in a bucket, and a pair just at
    the threshold missed by all tables with probability ``miss`` at most."""
    bits = min(40, max(4, math.ceil(math.log2(max(n, 2) / per_bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def most_different(signs: int, threshold: float) -> int:
    """Signs in which a pair at the threshold differs: six standard deviations above the mean."""
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + 6 * math.sqrt(signs * p * (1 - p)))


@lru_cache(maxsize=8)
def hyperplanes(size: int, columns: int) -> np.ndarray:
    """Fixed Gaussian directions for vectors of one length."""
    return np.random.default_rng([20_240_101, size]).standard_normal((size, columns))


def rows_of(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat float64 values (null components as NaN) and offsets; a null vector is empty."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component to 0.5 to 1, so squares stay in range.

    A row that is zero or not finite becomes NaN.
    """
    largest = np.abs(x).max(axis=1)
    good = np.isfinite(x).all(axis=1) & (largest > 0)
    exponent = np.frexp(np.where(good, largest, 1.0))[1]
    return np.where(good[:, None], np.ldexp(x, -exponent[:, None]), np.nan)


def cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray, values: int = 1 << 20) -> np.ndarray:
    """Cosines of the rows a and b of x.  A pair's value depends on its two rows alone."""
    norm = np.sqrt((x * x).sum(axis=1))
    out, step = np.zeros(len(a)), max(1, values // x.shape[1])
    for k in range(0, len(a), step):
        i, j = a[k : k + step], b[k : k + step]
        out[k : k + step] = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j])
    return out


def signed(vectors: DataFrame, id_col: str, vec_col: str, signs: int) -> DataFrame:
    """(id, vec, d1, d2, size, signature); the last four are null where a vector links with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = rows_of(batch.column(1))
            n, lengths = batch.num_rows, np.diff(at)
            able, digests = np.zeros(n, bool), np.zeros((n, 2), np.int64)
            packed: list[bytes | None] = [None] * n
            for size in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == size)
                x = flat[at[rows][:, None] + np.arange(size)]
                even = scaled(x)
                good = np.isfinite(even[:, 0])
                rows, x, even = rows[good], x[good], even[good]
                able[rows] = True
                digests[rows] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in x), np.int64).reshape(-1, 2)
                for i, row in zip(rows.tolist(), np.packbits(even @ hyperplanes(size, signs) > 0, axis=1)):
                    packed[i] = row.tobytes()
            made = [*(pa.array(digests[:, i], mask=~able) for i in (0, 1)), pa.array(lengths, pa.int32(), mask=~able), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["id", "vec", "d1", "d2", "size", "signature"])

    picked = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kinds = picked.schema["vec"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, vec {kinds}, d1 long, d2 long, size int, signature binary")


def _signs(packed: pa.Array) -> np.ndarray:
    """A 0/1 matrix from signatures of one length."""
    joined = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
    return np.unpackbits(joined, axis=1)


def bucketed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(key, node, signature): each node in its bucket of every table, with its first signs.

    A key holds the code (40 bits), the table (8) and the vector's length (15).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = _signs(batch.column(2))[:, : bits * tables]
            codes = signs.reshape(-1, tables, bits) @ powers + (np.arange(tables, dtype=np.int64) << 40)
            keys = codes + ((batch.column(1).to_numpy().astype(np.int64) & 0x7FFF) << 48)[:, None]
            short = pa.array([s[: SEARCH_BITS // 8] for s in batch.column(2).to_pylist()], pa.binary())
            at = pa.array(np.repeat(np.arange(batch.num_rows), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at), short.take(at)], names=["key", "node", "signature"])

    return classes.select("node", "size", "signature").mapInArrow(run, "key long, node long, signature binary")


def candidate_pairs(key: int, signs: np.ndarray, side: np.ndarray | None, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of one group whose signs differ little and agree in no table before the key's.

    ``signs`` may hold the signs of the first tables only; tables beyond it are not compared.
    """
    near = signs[:, :SEARCH_BITS]
    ones = near.astype(np.float32) * 2 - 1
    # The product is the number of equal signs less that of different ones.
    a, b = np.nonzero(np.triu(ones @ ones.T >= near.shape[1] - 2 * most_different(near.shape[1], threshold), 1))
    if side is not None:
        a, b = (x[side[a] != side[b]] for x in (a, b))
    table, known = key >> 40 & 0xFF, signs.shape[1] // bits
    if len(a) and min(table, known):
        codes = signs[:, : min(table, known) * bits].reshape(len(signs), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))
        new = np.ones(len(a), bool)
        for t in range(codes.shape[1]):
            new &= codes[a, t] != codes[b, t]
        a, b = a[new], b[new]
    return a, b


def with_candidates(rows: DataFrame, bits: int, threshold: float) -> DataFrame:
    """(key, _pair, node): the rows that form a candidate pair in their pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side in runs(batches):
            if group.num_rows < 2 or (side is not None and side[0] == side[-1]):
                continue
            a, b = candidate_pairs(group.column(0)[0].as_py(), _signs(group.column(3)), side, bits, threshold)
            if len(a):
                yield group.select([0, 1, 2]).take(pa.array(np.union1d(a, b)))

    return dealt(rows.select("key", "_pair", "node", "signature"), "key").mapInArrow(run, "key long, _pair long, node long")


def compared(rows: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(a, b, n): links (a, b, 0) that join each group, and link counts (a, null, n).

    ``rows``: key, _pair, node, vec, copies, signature (all signs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side in runs(batches):
            if group.num_rows < 2:
                continue
            signs = _signs(group.column(5))[:, : bits * tables]
            a, b = candidate_pairs(group.column(0)[0].as_py(), signs, side, bits, threshold)
            flat, at = rows_of(group.column(3))
            size = np.diff(at)
            alike = size[a] == size[b]
            a, b = a[alike], b[alike]
            links = np.zeros(len(a), bool)
            for width in np.unique(size).tolist():
                mine = np.flatnonzero(size == width)
                place = np.zeros(len(size), np.int64)
                place[mine] = np.arange(len(mine))
                of = size[a] == width
                x = scaled(flat[at[mine][:, None] + np.arange(width)])
                links[of] = cosines(x, place[a[of]], place[b[of]]) >= threshold
            a, b = a[links], b[links]
            if not len(a):
                continue
            copies, times = group.column(4).to_numpy(), np.zeros(group.num_rows, np.int64)
            np.add.at(times, a, copies[b])
            np.add.at(times, b, copies[a])
            chosen = forest(group.num_rows, a, b, np.arange(group.num_rows))
            counted = np.flatnonzero(times)
            nodes, n = group.column(2), len(chosen)
            one = nodes.take(pa.array(np.concatenate([a[chosen], counted])))
            two = nodes.take(pa.array(np.concatenate([b[chosen], counted]), mask=np.arange(n + len(counted)) >= n))
            yield pa.RecordBatch.from_arrays([one, two, pa.array(np.concatenate([np.zeros(n, np.int64), times[counted]]))], names=["a", "b", "n"])

    return dealt(rows.select("key", "_pair", "node", "vec", "copies", "signature"), "key").mapInArrow(run, "a long, b long, n long")


def near_duplicate_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    miss: float = 0.002,
    per_bucket: int = 64,
    block: int = 1024,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    n_links counts the other ids linked directly, copies included; component_id is the
    least id reachable; kept is id = component_id.  A vector that is null, empty, all zero
    or holds a null or non-finite component links with nothing, as does a null id (whose
    component is null and which is kept).  Vectors of different lengths never link.  Rows
    equal in id and vector are one; an id with several vectors has a row for each, linked
    as that vector is, and each counts by itself.  Other columns are not read.

    The number of bits follows from the number of rows, that of tables from the probability
    ``miss`` of losing a pair at the threshold; pairs above it are lost less often.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "hyperplanes")
    n_rows = vectors.count()
    bits, tables = tables_for(n_rows, threshold, miss, per_bucket)
    base = scratch.keep(signed(vectors, id_col, vec_col, bits * tables))
    able = base.where("id IS NOT NULL AND d1 IS NOT NULL")
    again = able.groupBy("d1", "d2", "id").agg((F.count("*") - 1).alias("more")).where("more > 0").groupBy("d1", "d2").agg(F.sum("more").alias("more"))
    least = F.min(F.struct("id", "vec", "size", "signature")).alias("least")
    classes = able.groupBy("d1", "d2").agg(least, F.count("*").alias("rows")).join(again, ["d1", "d2"], "left")
    classes = classes.select("d1", "d2", "least.*", "rows", (F.col("rows") - F.coalesce("more", F.lit(0))).alias("copies"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))

    members = bucketed(classes, bits, tables)
    large = scratch.keep(members.groupBy("key").count().where(F.col("count") > block))
    blocks = F.coalesce(F.ceil(F.col("count") / block), F.lit(1))
    parted = in_block_pairs(members.join(large, "key", "left"), "key", "node", blocks)
    found = scratch.keep(with_candidates(parted, bits, threshold))
    out = scratch.keep(compared(found.join(classes.select("node", "vec", "copies", "signature"), "node"), bits, tables, threshold))

    components = connected_components(out.where("b IS NOT NULL"), "a", "b", scratch).withColumnRenamed("id", "node")
    links = out.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = classes.select("d1", "d2", "node", "id", "rows", "copies").join(components, "node", "left").join(links, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node")).withColumn("n", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    heads = known.groupBy("component").agg(F.min("id").alias("c"), F.count("*").alias("count"))
    known = salted_join(known, heads, "component", "node", n_rows).select(F.struct("d1", "d2").alias("digest"), "rows", "n", "c")

    linked = salted_join(able.select("id", F.struct("d1", "d2").alias("digest")), known, "digest", "id", n_rows, "rows").select("id", "n", "c")
    alone = base.where("id IS NULL OR d1 IS NULL").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_links"),
        F.col("c").alias("component_id"),
        F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"),
    )
