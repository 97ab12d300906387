"""Runs of equal keys in sorted Arrow batches, and blocks of large groups.

A group that may be large is dealt as pairs of blocks of bounded size, so every task holds
two blocks at most, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than a SHARES-th of all rows is hot; fewer than SHARES keys can be.
SHARES = 500


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def salted_join(rows: DataFrame, keyed: DataFrame, key: str, spread: str, total: int, count_col: str = "count") -> DataFrame:
    """rows joined to ``keyed`` by ``key``; the rows of a hot key are dealt over tasks by hash of ``spread``.

    ``keyed`` has one row per key with the key's number of rows, ``count_col``, which is
    kept; ``total`` is the number of rows.  Only hot keys are broadcast: fewer than SHARES,
    whatever the input.
    """
    parts = F.ceil(F.col(count_col) * SHARES / F.lit(max(1, total))).cast("int")
    hot = keyed.where(F.col(count_col) * SHARES > total).select(key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def in_block_pairs(rows: DataFrame, key: str, id_col: str, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its block is in, with that pair as ``_pair``.

    ``blocks`` is the group's number of blocks, which bounds a block's size; rows are dealt
    to them by hash of the id.  ``_pair`` holds the lower block, the higher one and, in the
    last bit, which of two different blocks the row is from.
    """
    numbered = rows.withColumn("_blocks", blocks.cast("long")).withColumn("_block", F.pmod(F.xxhash64(id_col, F.lit("block")), "_blocks"))
    pairs = numbered.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    packed = F.shiftleft(low, 32) + F.shiftleft(high, 1) + (F.col("_block") > F.col("_other")).cast("long")
    return pairs.withColumn("_pair", packed).drop("_blocks", "_block", "_other")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a ``_pair``, each pair of blocks in one task and in a run, the lower block's rows first."""
    return rows.repartition(key, F.shiftright("_pair", 1)).sortWithinPartitions(key, "_pair")


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups, and where each group begins and the last ends.

    A group is a run of rows with one key and one pair of blocks, the first two columns
    (longs, no nulls); the last one of a batch waits for the next batch.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and _group_of(held[-1], -1) != _group_of(batch, 0):
            yield _whole(held)
            held = []
        change = _changes(batch)
        if len(change):
            held.append(batch.slice(0, int(change[-1])))
            yield _whole(held)
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield _whole(held)


def _group_of(batch: pa.RecordBatch, row: int) -> tuple[int, int]:
    return batch.column(0)[row].as_py(), batch.column(1)[row].as_py() >> 1


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    key, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy() >> 1
    return np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1


def _whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    return batch, np.concatenate([[0], _changes(batch), [batch.num_rows]])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray | None]]:
    """One batch for each group, and the side of each row, or None in a block's own pair."""
    for batch, starts in complete(batches):
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
            group = batch.slice(begin, end - begin)
            pair = group.column(1).to_numpy()
            yield group, None if pair[0] >> 32 == pair[0] >> 1 & 0x7FFFFFFF else pair & 1


def forest(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> list[int]:
    """Places in (a, b) of links that join groups not joined before; ``start`` groups the n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict = {}
    for i, s in enumerate(start.tolist()):
        parent[root(i)] = root(first.setdefault(s, i))
    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            out.append(k)
    return out
