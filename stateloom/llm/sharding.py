"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard levels.  At a node every child draws an exponential
variate from a hash of (key, child) at the rate of the child's weight, and the least draw
wins, so a child is chosen in proportion to its weight.  A draw depends only on its own
child's weight: raising one weight moves keys only into that subtree, lowering it moves
keys only out, and choices inside other subtrees stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def weight_of(node) -> float:
    return float(sum(map(weight_of, node.values()))) if isinstance(node, Mapping) else float(node)


def _draw(key: Column, path: tuple, weight: float) -> Column:
    """An exponential variate at rate ``weight``; the hash's upper 53 bits, never 0."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit("/".join(map(str, path)))), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _descend(key: Column, node, path: tuple) -> Column:
    if not isinstance(node, Mapping):
        return F.lit(path[-1]).cast("int")
    children = {c: sub for c, sub in node.items() if weight_of(sub) > 0}
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    if len(children) == 1:
        ((c, sub),) = children.items()
        return _descend(key, sub, (*path, c))
    draws = [F.struct(_draw(key, (*path, c), weight_of(sub)).alias("draw"), F.lit(i).alias("i")) for i, (c, sub) in enumerate(children.items())]
    best = F.least(*draws)["i"]
    out = None
    for i, (c, sub) in enumerate(children.items()):
        below = _descend(key, sub, (*path, c))
        out = F.when(best == i, below) if out is None else out.when(best == i, below)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) of a key; a null key is a key of its own."""
    return _descend(key, tree, ())


def hash_tree_shards(
    docs: DataFrame, tree: Tree, grown: Tree | None = None, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024, run: int = 1024
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (a null text has none).  slot numbers a shard's
    rows from 0 without gaps, by hash bucket of id, checksum and size, then these three.
    Rows equal in all three are counted before anything is ordered and go on as runs of at
    most ``run`` rows, each in a bucket of its own, so neither one id nor one row with very
    many copies is ordered in one task.  Runs are placed inside (shard, bucket) and shifted by
    the rows of earlier buckets, at most shards x buckets numbers.  Rows equal in everything
    are interchangeable.  Null ids are one key, hence in one shard, but in all of its
    buckets.  Only id and text are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    rows = docs.select(
        key,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    # Equal rows become one row and a count, and that runs of bounded length.
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    split = equal.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(run).cast("long"))))
    runs = split.withColumn("_rows", F.least(F.col("_n") - F.col("_from"), F.lit(run).cast("long")))
    runs = runs.withColumn("_bucket", F.pmod(F.xxhash64(key, "text_crc32", "size", "_from", F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = runs.groupBy("shard", "_bucket").agg(F.sum("_rows").alias("_all"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size", "_from").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("_earlier", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    # At most shards x buckets rows of three numbers: a proven bound for the broadcast.
    numbered = placed.join(F.broadcast(offsets), ["shard", "_bucket"]).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rows") - 1)))
    return numbered.select(
        id_col, "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_earlier") + F.col("_at")).cast("long").alias("slot"), "grown_shard"
    )
