"""Line dedup by overlapping windows of three lines.

Every run of ``width`` consecutive lines is hashed.  Of equal windows anywhere in the corpus
the first, by (id, position), stays; the lines that later occurrences cover are merged and
removed.  A removed line always has an equal line at an earlier place, so the first
occurrence of a line is never lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import line_windows, text_slices
from ._worker import release

WORDLESS = r"[^\x20\x09-\x0D]"


def later_occurrences(found: DataFrame, digest: list[str], place: list[str]) -> DataFrame:
    """The rows of ``found`` whose digest also occurs at an earlier place, with ``_first``.

    ``_first`` is the struct of the earliest place.  The earliest place of a digest comes
    from a pre-aggregated minimum; the rows then join to the digests that repeat, one row
    each, which Spark splits where a digest is hot.
    """
    at = F.struct(*place)
    firsts = found.groupBy(*digest).agg(F.min(at).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return found.join(firsts, digest).where(at > F.col("_first"))


def _windows(keyed: DataFrame, text_col: str, width: int) -> DataFrame:
    """(_id, _text_hash, pos, h1, h2): the windows of every text that hold a word."""
    kind = keyed.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(2)):
                owner, pos, digest = line_windows(data, offsets, width)
                at = pa.array(owner + row)
                arrays = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x) for x in (pos, digest[:, 0], digest[:, 1]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_text_hash", "pos", "h1", "h2"])

    texts = keyed.select("_id", "_text_hash", F.coalesce(F.col(f"_row.{text_col}"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"_id {kind}, _text_hash long, pos long, h1 long, h2 long")


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """The rows of ``docs`` with covered lines removed from the text, and n_lines, n_removed (long).

    Lines end at "\\n" and are compared as they are.  Windows without a word, and texts of
    fewer than ``width`` lines, repeat nothing.  A null text stays null with 0 lines; a text
    all of whose lines are covered becomes empty.  Rows that repeat an id are told apart by
    their text's hash, and rows equal in both are one occurrence; a null id sorts first.
    The columns of ``docs`` are kept; the two counts are named by ``counts`` and replace
    columns of those names.

    Windows cross the network as 128-bit digests with their place, texts once.
    """
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"))
    later = later_occurrences(_windows(keyed, text_col, width), ["h1", "h2"], ["_id", "_text_hash", "pos"])
    covered = later.groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("pos")).alias("_starts"))
    same = keyed["_id"].eqNullSafe(covered["_id"]) & (keyed["_text_hash"] == covered["_text_hash"])
    joined = keyed.join(covered, same, "left").select("_row", "_starts")
    columns = [c for c in docs.columns if c.lower() not in [n.lower() for n in counts]]
    spread = joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], "_starts")
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in counts)])
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, starts in zip(batch.column(at).to_pylist(), batch.column(len(columns)), strict=True):
                kept, total, gone = text, 0, 0
                if text is not None:
                    total = text.count("\n") + 1
                    if starts.is_valid:
                        covered = np.zeros(total, bool)
                        begin = starts.values.to_numpy()
                        for k in range(width):
                            covered[begin + k] = True
                        gone = int(covered.sum())
                        kept = "\n".join(line for line, c in zip(text.split("\n"), covered, strict=True) if not c)
                texts.append(kept)
                n_lines.append(total)
                n_removed.append(gone)
            arrays = batch.columns[: len(columns)]
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return spread.mapInArrow(run, schema)
