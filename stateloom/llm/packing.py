"""Sum-of-squares packing of tokenised documents into fixed windows.

A document's ids are cut into full windows and one remainder.  Remainders arrive one by
one and are placed online: of all fill levels that have a partially filled window with
room, and of a new window, the one that makes the sum of squared level counts least is
taken (the fullest on ties).  The counts stand in a level array.

Documents are dealt into groups of bounded size, by hash or, where an order is given, by
ranges of it; each group has a level array of its own, so groups pack in parallel and only
lengths and checksums are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._worker import held

#: Chunks kept in each of two generations, and the longest chunk kept, in one Python worker.
MEMO_CHUNKS, MEMO_CHARS = 100_000, 48
#: Places that the byte-level split never crosses: a word with its space, or white space.
_CHUNK = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: Characters that the two regex engines class differently as white space.
_ODD = re.compile("[\x1c-\x1f]")


class IdEncoder:
    """Ids of whole texts as packed 32-bit little-endian bytes, equal to the tokenizers file's.

    The vocabulary splits texts at fixed places, so the ids of short chunks are kept in a
    bounded memo; a chunk outside the memo is merged under the same vocabulary's rank file.
    Texts with an added token's string or an odd control character go to the library whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if _ODD.search(text) or any(s in text for s in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo, chunks = self.memo, _CHUNK.findall(text)
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:
            pass
        out = []
        for c in chunks:
            got = memo.get(c)
            if got is None:
                got = self.older.get(c)
                if got is None:
                    got = np.array(self.ranks.encode_ordinary(c), "<u4").tobytes()
                if len(c) <= MEMO_CHARS:
                    if len(memo) >= MEMO_CHUNKS:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[c] = got
            out.append(got)
        return b"".join(out)


def id_encoder(json_path: str, ranks_path: str, pattern: str) -> IdEncoder:
    return held(("ids", json_path, ranks_path, pattern), lambda: IdEncoder(json_path, ranks_path, pattern))


class LevelArray:
    """Online sum-of-squares placement into windows of one capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # partially filled windows by level
        self.open: dict[int, list[int]] = {}
        self.windows = 0

    def place(self, length: int, avoid: Collection[int] = ()) -> tuple[int, int]:
        """(window, offset) of a piece of 1 to capacity - 1 tokens, in no window of ``avoid``."""
        count, room = self.count, self.capacity - length
        levels = np.flatnonzero(count[: room + 1])
        if avoid:
            levels = np.array([h for h in levels.tolist() if any(w not in avoid for w in self.open[h])], np.int64)
        level, least = 0, 2 * int(count[length]) + 1
        if len(levels):
            change = 2 * (count[levels + length] - count[levels]) + 2
            change[levels == room] -= 1  # the window is full and leaves the array
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= least:
                level = int(levels[best])
        if level:
            windows = self.open[level]
            window = windows.pop(next(i for i in range(len(windows) - 1, -1, -1) if windows[i] not in avoid))
            count[level] -= 1
        else:
            window = self.windows
            self.windows += 1
        if level + length < self.capacity:
            count[level + length] += 1
            self.open.setdefault(level + length, []).append(window)
        return window, level

    def full(self) -> int:
        self.windows += 1
        return self.windows - 1


def pack_group(docs: pd.DataFrame, id_col: str, capacity: int) -> pd.DataFrame:
    """The pieces of one group's documents, taken in the order given, then of id, length and checksums.

    Where an order is given, no two passes of a document put their last pieces in one window.
    """
    ordered = "_order" in docs.columns
    docs = docs.sort_values([*["_order"] * ordered, id_col, "doc_tokens", "_first"], na_position="first", kind="stable")
    levels, out, held = LevelArray(capacity), [], {}
    group = int(docs["_group"].iloc[0]) << 32
    for doc, total, checks, times in zip(docs[id_col], docs["doc_tokens"], docs["_checks"], docs["_times"], strict=True):
        for k, check in [*enumerate(checks)] * times:
            start = k * capacity
            length = min(capacity, total - start)
            if length == capacity:
                window, offset = levels.full(), 0
            elif ordered:
                mine = held.setdefault((None if pd.isna(doc) else doc, total, *checks), set())
                window, offset = levels.place(length, mine)
                mine.add(window)
            else:
                window, offset = levels.place(length)
            out.append((doc, start, length, int(check), total, group + window, offset))
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    made = pd.DataFrame(out, columns=columns)
    return made.astype({c: "int64" for c in columns[1:]}).astype({id_col: docs[id_col].dtype})


def pack_documents(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    group_rows: int = 8192,
    order_col: str | None = None,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and ``end_id``; a null or empty text is ``end_id``
    alone.  Sequences are padded to ``capacity`` by whoever reads them.  The number of
    groups follows from the number of rows, and a row's group from its id and tokens, so
    reruns and retries agree.  Null or repeated ids pack as rows of their own; rows equal
    in id and tokens are counted before they are dealt, so many of them fill many groups.
    Other columns are not read.

    ``order_col`` names the rows' ranks in an order to keep (long, from 0, no nulls): every
    ``group_rows`` ranks are a group, a group packs in order of rank, and sequences are
    numbered by the rank of their first piece.  A piece that fills up an open sequence
    stands before its rank by the length of a group at most.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(json_path, ranks_path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            totals, checks = [], []
            for t in batch.column(0):
                ids = encoder.ids(t.as_py()) + end
                totals.append(len(ids) // 4)
                checks.append([zlib.crc32(ids[i : i + width]) for i in range(0, len(ids), width)])
            made = [pa.array(totals, pa.int64()), pa.array(checks, pa.list_(pa.int64()))]
            names = [id_col, "doc_tokens", "_checks", *["_order"] * (batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(1), *made, *batch.columns[2:]], names=names)

    order = [] if order_col is None else [F.col(order_col).cast("long").alias("_order")]
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col), *order)
    tokens = texts.mapInArrow(run, f"`{id_col}` {kind}, doc_tokens long, _checks array<long>" + ", _order long" * len(order))
    if order:
        dealt = tokens.withColumn("_times", F.lit(1)).withColumn("_group", F.expr(f"_order div {int(group_rows)}"))
    else:
        # Rows equal in id and tokens become one row and a count, split where it is larger than a group.
        tokens = (scratch or Scratch(docs.sparkSession, "packing")).keep(tokens)
        groups = max(1, -(-tokens.count() // group_rows))
        equal = tokens.groupBy(id_col, "doc_tokens", "_checks").agg(F.count("*").alias("_n"))
        split = equal.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(group_rows).cast("long"))))
        times = F.least(F.col("_n") - F.col("_from"), F.lit(group_rows)).cast("int")
        group = F.pmod(F.xxhash64(id_col, "doc_tokens", "_checks", "_from"), F.lit(groups))
        dealt = split.select(id_col, "doc_tokens", "_checks", times.alias("_times"), group.alias("_group"))
    dealt = dealt.withColumn("_first", F.element_at("_checks", 1))
    out = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(lambda g: pack_group(g, id_col, capacity), out)
