"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text, h = 2h + gear[byte]; a chunk ends where the
hash's lower bits are zero, at least ``least`` and at most ``most`` bytes after it began.
The lower 16 bits depend on the last 16 bytes only, so chunk ends fall at the same places of
a passage wherever it stands, and an insertion shifts only the chunks around it.  Of equal
chunks (128-bit digest) the first by (id, text hash, start) stays; runs of later occurrences
are the repeated spans, those of fewer than ``least_span`` bytes marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import digests, seeds, text_slices
from ._groups import fresh
from .line_dedup import later_occurrences

_GEAR = (seeds(256, 2016) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The lower 16 bits of the rolling hash after each byte, by doubling the window."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h << np.uint16(step)
        h = h.copy()
        h[step:] += shifted[:-step]
    return h


def chunk_ends(data: np.ndarray, mask: int, least: int, most: int) -> np.ndarray:
    """Ends of the chunks of one text's bytes; the last is the text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends, at = [], 0
    for c in (np.flatnonzero((gear_hashes(data) & np.uint16(mask)) == 0) + 1).tolist():
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            at = c
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return np.array(ends, np.int64)


def chunks(docs: DataFrame, id_col: str, text_col: str, mask: int, least: int, most: int) -> DataFrame:
    """(id, text_hash, start, length, d1, d2, last): the chunks of every text, in bytes of its UTF-8."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(0)):
                starts, begins, lengths, counts = [], [], [], []
                for i, base in enumerate(offsets[:-1].tolist()):
                    ends = chunk_ends(data[base : offsets[i + 1]], mask, least, most)
                    begin = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
                    starts.append(begin)
                    begins.append(begin + base)
                    lengths.append(ends - begin)
                    counts.append(len(ends))
                start, begin, length = map(np.concatenate, (starts, begins, lengths))
                digest = digests(data, begin, begin + length)
                owner = np.repeat(np.arange(row, row + len(counts)), counts)
                last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
                held = [batch.column(i).take(pa.array(owner)) for i in (1, 2)]
                made = [pa.array(x) for x in (start, length.astype(np.int32), digest[:, 0], digest[:, 1], last)]
                yield pa.RecordBatch.from_arrays([*held, *made], names=["id", "text_hash", "start", "length", "d1", "d2", "last"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    return texts.mapInArrow(run, f"id {kind}, text_hash long, start long, length int, d1 long, d2 long, last boolean")


def repeated_spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    mask: int = 31,
    least: int = 16,
    most: int = 512,
    least_span: int = 80,
) -> DataFrame:
    """One row per repeated span: id, text_hash, start, length (bytes of the text's UTF-8), n_chunks, first_ids, whole, short.

    A span is a maximal run of neighbouring chunks that occur earlier in the corpus;
    first_ids are the sorted ids where its chunks occur first.  whole marks a span that is
    its whole text, short one of fewer than ``least_span`` bytes; none is left out.  Texts that repeat nothing,
    null and empty texts give no row.  Rows that repeat an id (null ids too) are told apart
    by text_hash, the text's xxhash64; rows equal in both are one occurrence.  A null id
    sorts first.  Only id and text are read, and texts are not shuffled: chunks cross the
    network as digests with their places.
    """
    found = chunks(docs, id_col, text_col, mask, least, most)
    place = ["id", "text_hash", "start"]
    later = later_occurrences(found, ["d1", "d2"], place).select(*place, "length", "last", F.col("_first.id").alias("first"))
    # Chunks that repeat, by text: at most one text's chunks in a window.
    by_place = Window.partitionBy("id", "text_hash").orderBy("start")
    opens = F.coalesce(F.lag(F.col("start") + F.col("length")).over(by_place) < F.col("start"), F.lit(True))
    numbered = later.dropDuplicates(place).withColumn("_opens", opens.cast("int"))
    numbered = numbered.withColumn("_run", F.sum("_opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("id", "text_hash", "_run").agg(
        F.min("start").alias("start"),
        F.sum("length").cast("long").alias("length"),
        F.count("*").alias("n_chunks"),
        F.sort_array(F.collect_set("first")).alias("first_ids"),
        F.max("last").alias("_ends"),
    )
    whole, short = (F.col("start") == 0) & F.col("_ends"), F.col("length") < least_span
    return spans.select(F.col("id").alias(id_col), "text_hash", "start", "length", "n_chunks", "first_ids", whole.alias("whole"), short.alias("short"))


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans' bytes cut out of the texts; a cut character goes as a whole.

    Spans are those of ``repeated_spans``, or those of them to be cut; texts without spans are unchanged.
    """
    # The columns of ``docs`` travel in a struct, so none can clash.
    place = F.struct(F.col(id_col).alias("id"), F.col("text_hash")).alias("place")
    cuts = spans.groupBy(place).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("cuts"))
    at = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), at.alias("at"))
    same = F.col("at.id").eqNullSafe(F.col("place.id")) & (F.col("at.text_hash") == F.col("place.text_hash"))
    joined = rows.join(cuts, same, "left").select("row.*", F.col("cuts").alias(fresh("cuts", docs.columns)))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None and cuts:
                    raw, parts, done = text.encode(), [], 0
                    for cut in cuts:
                        parts.append(raw[done : cut["start"]])
                        done = cut["start"] + cut["length"]
                    text = b"".join(p.decode(errors="ignore").encode() for p in [*parts, raw[done:]]).decode()
                texts.append(text)
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
