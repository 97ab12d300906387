"""Fill-in-the-middle transformation over an index of distinct texts.

A text is cut at ends of its tokens (white space with the word after it).  Copies of a text
have the same ends, so these are found once for each distinct text: rows with equal text
digests are dealt to the same tasks, copies are verified byte by byte against the text that
the index holds, and the ends become one Elias-Fano list.  Documents join their text's entry
there, and each seeded cut is a select in the list, not another pass over the text.

Texts cross the network once: the index, its verification and the join back share one
exchange.  A digest with more than a 500th of all rows is dealt over several tasks, each of
which holds the entry once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._groups import SHARES

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Characters of texts in one batch that goes out.
OUTPUT_CHARS = 4 << 20
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


class EliasFano:
    """A list of rising integers: lower bits packed, upper bits in unary, a sample of every 256th one.

    Each value takes about 2 bits more than its share of the universe needs.  ``select(i)``
    reads the bytes between two samples, whatever the list's length.
    """

    SAMPLE = 256

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.width = max(0, (universe // self.n).bit_length() - 1) if self.n else 0
        values = np.asarray(values, np.int64)
        bits = (values[:, None] >> np.arange(self.width)) & 1
        self.lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> self.width) + np.arange(self.n)
        upper = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        upper[ones] = 1
        self.upper = np.packbits(upper, bitorder="little")
        self.samples = ones[:: self.SAMPLE].astype(np.int64)

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        sample = i // self.SAMPLE
        begin = int(self.samples[sample])
        end = int(self.samples[sample + 1]) if sample + 1 < len(self.samples) else 8 * len(self.upper)
        first = begin // 8
        seen = np.flatnonzero(np.unpackbits(self.upper[first : end // 8 + 1], bitorder="little")[begin - 8 * first :])
        high = begin + int(seen[i % self.SAMPLE]) - i
        at = i * self.width
        part = np.unpackbits(self.lower[at // 8 : (at + self.width + 7) // 8], bitorder="little")[at % 8 : at % 8 + self.width]
        low = int(part.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))) if self.width else 0
        return high << self.width | low

    def nbytes(self) -> int:
        return self.lower.nbytes + self.upper.nbytes + self.samples.nbytes


def token_ends(text: str) -> np.ndarray:
    """Where the tokens of a text end, in code points; the last is the text's length."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.isin(points, _SPACES)
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(points)) if len(points) and space[-1] else ends


@dataclass
class Entry:
    """What the index holds of one distinct text."""

    text: str
    ends: EliasFano
    marked: bool

    @classmethod
    def of(cls, text: str) -> Entry:
        return cls(text, EliasFano(token_ends(text), len(text)), any(m in text for m in MARKS))

    def cut(self, units: int) -> int:
        """The place after so many tokens."""
        return self.ends.select(units - 1) if units else 0


def draws(seed: int, doc_id: object) -> list[int]:
    """Four 32-bit draws from the seed and a document's id; a null id is spelled as nothing."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(entry: Entry, seed: int, doc_id: object, share: int, spm_share: int) -> tuple[str, str, int | None, int | None]:
    """(form, output, prefix_chars, middle_chars) of one document, from its text's entry."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    text = entry.text
    if not text or entry.marked or h3 % 100 >= share:
        return "plain", text, None, None
    n = entry.ends.n
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = entry.cut(low), entry.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_share:
        return "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    The text held no mark, and none can arise where a part meets one, so the marks cut an
    output into its parts again.
    """
    part = [F.get(F.split(output, "<[PSM]>", -1), F.lit(i)) for i in range(4)]
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def dealt_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, share, id, text), copies of a text side by side; the rows of a hot text over several tasks.

    Rows are counted by digest first.  Only hot digests are broadcast: fewer than 500,
    whatever the input.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.md5(text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    counts = docs.select(F.md5(text).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n >= 32")
    total = docs.count()
    hot = counts.where(F.col("n") * SHARES > total).select("key", F.ceil(F.col("n") * SHARES / F.lit(max(1, total))).cast("int").alias("shares"))
    share = F.pmod(F.monotonically_increasing_id(), F.coalesce("shares", F.lit(1))).cast("int")
    spread = rows.join(F.broadcast(hot), "key", "left").select("key", share.alias("share"), "id", "text")
    return spread.repartition("key", "share").sortWithinPartitions("key", "share")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    share: int = 50,
    spm_share: int = 80,
) -> DataFrame:
    """One row per row of ``docs``: id, n, form, output, prefix_chars, middle_chars.

    n is the text's number of tokens.  ``share`` percent of the documents are cut, by the
    hash of the seed and the id; of these ``spm_share`` percent give the suffix first (spm),
    the others the prefix (psm).  A text that is empty or holds a mark stays plain.
    prefix_chars and middle_chars count code points and are null in plain rows.  A null text
    is empty; a null id is spelled as nothing in the hash; repeated ids are rows of their
    own, cut alike; other columns are neither read nor returned.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [id_col, "n", "form", "output", "prefix_chars", "middle_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries = None, []
        for batch in batches:
            begin = size = 0
            rows: list[tuple] = []
            places = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for i, (place, doc, text) in enumerate(zip(places, batch.column(2).to_pylist(), batch.column(3), strict=True)):
                if place != at:
                    at, entries = place, []
                text = text.as_py()
                # Texts that share a digest are one entry only if they are equal.
                entry = next((e for e in entries if e.text == text), None)
                if entry is None:
                    entry = Entry.of(text)
                    entries.append(entry)
                rows.append((entry.ends.n, *transformed(entry, seed, doc, share, spm_share)))
                size += len(text)
                if size > OUTPUT_CHARS or i == batch.num_rows - 1:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(begin, len(rows)), *made], names=names)
                    begin, size, rows = i + 1, 0, []

    schema = f"`{id_col}` {kind}, n long, form string, output string, prefix_chars long, middle_chars long"
    return dealt_texts(docs, id_col, text_col).mapInArrow(run, schema)
