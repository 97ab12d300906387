"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i < t every shingle is hashed to one
of t bins and each still empty bin keeps the least hash it gets; in rounds t to 2t - 1 every
shingle goes to one fixed bin.  So every coordinate fills, and sketches concentrate like t
independent minima at the cost of about one pass over the shingles.

Documents with equal shingle sets are one class, a numbered node.  Classes that agree on all
rows of a band share a bucket and are candidates; links are confirmed on full shingle sets.
A bucket never emits all its pairs: first every class is verified against the bucket's hub,
the member that lies in the largest buckets; large buckets whose members are not yet
connected try further hubs; then, only in buckets that still hold several components, blocks
of members are compared inside tasks, and only links that join components come out.  What
is left unverified is already connected, so the components are those of all candidate pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import mix, seeds, shingle_set, text_slices, word_hashes
from ._groups import dealt, forest, in_block_pairs, runs, salted_join
from ._scratch import Scratch
from ._worker import release
from .components import connected_components

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Sketcher:
    """Sketches of t coordinates (t < 128) of sets of 64-bit hashes."""

    def __init__(self, t: int):
        if not 0 < t < 128:
            raise ValueError("1 to 127 coordinates")
        self.t = t
        self.seeds = seeds(2 * t, 99)
        self.enough = 2 * t * (math.log(t) + 1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """t values; the upper 7 bits hold the round, so earlier rounds win.  Not for an empty set."""
        t, n = self.t, len(shingles)
        out = np.full(t, _EMPTY)
        done = 0
        while done < t:
            rounds = min(t - done, max(1, math.ceil(self.enough / n)))
            hashes = mix(shingles[None, :] ^ self.seeds[done : done + rounds, None])
            bins = (hashes % np.uint64(t)).astype(np.int64)
            order = np.arange(done, done + rounds, dtype=np.uint64) << np.uint64(57)
            np.minimum.at(out, bins.ravel(), (order[:, None] | (hashes >> np.uint64(7))).ravel())
            done += rounds
            if not (out == _EMPTY).any():
                return out
        for b in np.flatnonzero(out == _EMPTY):
            out[b] = mix(shingles ^ self.seeds[t + b]).min() | np.uint64(127 << 57)
        return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = seeds(rows, 4321) | np.uint64(1)
    return mix((sketch[: bands * rows].reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + seeds(bands, 8765))


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit digest (text) of id and text, never null; null and empty texts differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat(parts[0], F.lit("\n"), parts[1]))


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, lower: bool) -> DataFrame:
    """id, row_key, n_bytes, n_shingles, two checksums of the shingle set (null if it is empty), band hashes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sketcher = Sketcher(bands * rows)
        for batch in batches:
            sizes, one, two, banded = [], [], [], []
            for _, data, offsets in text_slices(batch.column(0)):
                words, first = word_hashes(data, offsets, lower)
                for i in range(len(offsets) - 1):
                    found = shingle_set(words[first[i] : first[i + 1]], width)
                    sizes.append(len(found))
                    if len(found):
                        one.append(int(mix(found).sum(dtype=np.uint64).view(np.int64)))
                        two.append(int(mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)))
                        banded.append(band_hashes(sketcher(found), bands, rows).view(np.int64))
                    else:
                        one.append(None)
                        two.append(None)
                        banded.append(None)
            made = [pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(banded, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=["id", "row_key", "n_bytes", "n_shingles", "_one", "_two", "_bands"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    return texts.mapInArrow(run, f"id {kind}, row_key string, n_bytes long, n_shingles long, _one long, _two long, _bands array<long>")


def _sets(texts: pa.Array, width: int, lower: bool) -> list[np.ndarray]:
    out = []
    for _, data, offsets in text_slices(texts):
        words, first = word_hashes(data, offsets, lower)
        out += [shingle_set(words[first[i] : first[i + 1]], width) for i in range(len(offsets) - 1)]
    return out


def verified(spokes: DataFrame, texts: DataFrame, percent: int, width: int, lower: bool, fan: int = 256) -> DataFrame:
    """The pairs (a, b) of (hub, node) whose full shingle sets have 100 * intersection >= percent * union.

    A hub's text travels once for every ``fan`` nodes held against it, and is the only set
    that a task holds besides the node at hand.
    """
    n = spokes.count()
    fans = spokes.groupBy("hub").agg(F.count("*").alias("count"))
    parts = F.ceil(F.col("count") / fan).cast("int")
    parted = salted_join(spokes, fans, "hub", "node", n).select("hub", F.pmod(F.xxhash64("node", F.lit("fan")), parts).cast("int").alias("part"), F.lit(1).alias("turn"), "node")
    hubs = fans.select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("turn"), F.col("hub").alias("node"))
    sided = parted.unionByName(hubs).join(texts, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            hub, part, turn = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for i, x in enumerate(_sets(batch.column(4), width, lower)):
                if turn[i] == 0:
                    at, held = (hub[i], part[i]), x
                    continue
                if at != (hub[i], part[i]):
                    raise ValueError("a node stands before its hub")
                both = np.concatenate([held, x])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select([0, 3]).filter(pa.array(keep)).rename_columns(["a", "b"])

    return sided.select("hub", "part", "turn", "node", "text").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the pairwise intersections, from products of 0/1 blocks of shared hashes."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    index = np.cumsum(new) - 1
    often = np.bincount(index)[index] > 1
    column = np.unique(index[often], return_inverse=True)[1]
    owner = owner[often]
    out = np.zeros((n, n), np.int32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, columns):
        part = slice(*np.searchsorted(column, [at, at + columns]))
        block = np.zeros((n, columns), np.float32)
        block[owner[part], column[part] - at] = 1
        out += (block @ block.T).astype(np.int32)  # exact: ``columns`` at most
    return out


def similar(common: np.ndarray, size: np.ndarray, percent: int, rows: int = 64) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, in 64-bit integers, some rows at a time."""
    out = np.zeros(common.shape, bool)
    for at in range(0, len(size), rows):
        part = common[at : at + rows].astype(np.int64)
        out[at : at + rows] = 100 * part >= percent * (size[at : at + rows, None] + size[None, :] - part)
    return out


def links_in_blocks(rows: DataFrame, percent: int, width: int, lower: bool) -> DataFrame:
    """Links (a, b) that join the components c of each block pair's members.

    ``rows`` are from ``in_block_pairs``, with key, node, c and text.  All pairs
    of a block pair are compared on full sets inside the task; at most one link fewer than
    it has members comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side in runs(batches):
            component = group.column(3).to_numpy()
            if (component == component[0]).all() or (side is not None and (side == side[0]).all()):
                continue
            sets = _sets(group.column(4), width, lower)
            linked = np.triu(similar(shared_counts(sets), np.array([len(s) for s in sets], np.int64), percent), 1)
            linked &= component[:, None] != component[None, :]
            if side is not None:
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(linked)
            if len(a):
                chosen = forest(len(sets), a, b, component)
                nodes = group.column(2)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(x[chosen])) for x in (a, b)], names=["a", "b"])

    return dealt(rows.select("key", "_pair", "node", "c", "text"), "key").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 5,
    lower: bool = True,
    block: int = 512,
    block_bytes: int = 4 << 20,
    hub_rounds: int = 2,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, row_key, n_shingles, component_id, kept, stays.

    A document's set is its distinct ``width``-word shingles (letters A-Z lower-cased if
    ``lower``); with fewer words it is the whole sequence; without words or text it is
    empty, linked with nothing, and kept.  Documents link if 100 * intersection >= percent *
    union.  component_id is the least id reachable by links, and kept is id = component_id.
    Rows are told apart by id and text (``row_key``), so an id may repeat with other texts.
    A null id links as others do: it is never a component_id while its component holds an
    id, and is kept where none does.  ``stays`` is true for one row_key of each component,
    of the least id, and for all documents with empty sets.  Other columns are not read.

    A pair of similarity s is a candidate with probability 1 - (1 - s**rows)**bands: misses
    are 1 in 1,300,000 at 0.85 and 1 in 14,000 at 0.80 with the defaults.  A block holds up
    to about ``block`` classes and ``block_bytes`` of text.
    """
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    sets = ["_one", "_two", "n_shingles"]
    base = scratch.keep(sketched(docs, id_col, text_col, width, bands, rows, lower))
    n_rows = base.count()

    # Equal sets are one class, shown by the text of its least id; its number is fixed once written.
    named = F.struct(F.col("id").isNull().alias("nameless"), "id", "row_key", "n_bytes")
    classes = base.where("_one IS NOT NULL").groupBy(*sets).agg(F.min(named).alias("least"), F.count("*").alias("copies"), F.any_value("_bands").alias("_bands"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))

    members = classes.select("node", F.col("n_shingles").alias("n"), F.col("least.n_bytes").alias("n_bytes"), F.explode("_bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("count"), F.sum("n_bytes").alias("bytes")).where("count > 1")
    n_members = classes.count() * bands
    members = scratch.keep(salted_join(members, buckets, "key", "node", n_members))
    n_members = members.count()

    # The texts of classes that share a bucket: all that later steps read.
    shared = members.select("node").distinct().join(classes.select("node", F.col("least.row_key").alias("row_key")), "node")
    texts = docs.select(row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Repeated rows fold into one before texts cross the network, so none are joined together.
    texts = scratch.keep(texts.dropDuplicates(["row_key"]).join(shared, "row_key").select("node", "text"))

    def held_against(rows: DataFrame, rank: Column) -> DataFrame:
        """Links of each member to its bucket's hub, the member of least ``rank``."""
        first = F.min(F.struct(rank.alias("rank"), F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("c").alias("hc"))).alias("h")
        hubs = rows.groupBy("key").agg(first, F.count("*").alias("count")).select("key", "h.hub", "h.hn", "h.hc", "count")
        spokes = salted_join(rows.drop("count"), hubs, "key", "node", n_members).where("node <> hub AND c <> hc")
        similar = spokes.where(f"100 * least(n, hn) >= {percent} * greatest(n, hn)")
        spokes = scratch.keep(similar.select("hub", "node").distinct())
        return scratch.keep(verified(spokes, texts, percent, width, lower))

    def unconnected(found: DataFrame) -> DataFrame:
        """Members, with their components c, of buckets that hold several components."""
        now = members.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        split = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("rows")).where("lo <> hi").select("key", "rows")
        return scratch.keep(salted_join(now, split, "key", "node", n_members, "rows").drop("rows"))

    score = members.groupBy("node").agg(F.sum("count").alias("score"))
    links = held_against(members.join(score, "node").withColumn("c", F.col("node")), -F.col("score"))
    found = scratch.keep(connected_components(links, "a", "b", scratch))
    rest = unconnected(found)
    blocks = F.ceil(F.greatest(F.col("count") / block, F.col("bytes") / block_bytes))
    for turn in range(1, hub_rounds):
        # Buckets of one block are compared outright; larger ones try further hubs first.
        large = rest.where(blocks > 1)
        if large.isEmpty():
            break
        links = held_against(large, F.xxhash64("node", F.lit(turn)))
        if links.isEmpty():
            break
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = scratch.keep(connected_components(stars.unionByName(links), "a", "b", scratch))
        rest = unconnected(found)

    more = links_in_blocks(in_block_pairs(rest.join(texts, "node"), "key", "node", blocks), percent, width, lower)
    stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = connected_components(stars.unionByName(more), "a", "b", scratch)

    # Each class with the least name of its component.
    grouped = classes.select("node", *sets, "copies", "least").join(final.withColumnRenamed("id", "node"), "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    heads = grouped.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("count"))
    headed = salted_join(grouped, heads, "component", "node", n_members).select(F.struct(*sets).alias("set"), "copies", "head")
    able = base.where("_one IS NOT NULL").select("id", "row_key", F.struct(*sets).alias("set"))
    linked = salted_join(able, headed, "set", "row_key", n_rows, "copies").select(
        "id",
        "row_key",
        "set.n_shingles",
        F.col("head.id").alias("component_id"),
        (F.col("head.id").isNull() | F.coalesce(F.col("id") == F.col("head.id"), F.lit(False))).alias("kept"),
        (F.col("row_key") == F.col("head.row_key")).alias("stays"),
    )
    alone = base.where("_one IS NULL").select("id", "row_key", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays"))
    return linked.unionByName(alone).withColumnRenamed("id", id_col)
