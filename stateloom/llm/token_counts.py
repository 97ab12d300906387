"""Token counts by heap-and-linked-list byte-pair merging.

A text's initial symbols are its characters.  A heap holds the adjacent pairs that form
a piece of the vocabulary; the pair of lowest rank (leftmost on ties) is popped and
merged through a doubly linked list, and pairs that a merge has made stale are skipped.
The count is the number of initial symbols minus the number of merges; a symbol that
stays outside the vocabulary counts its UTF-8 bytes (byte fallback).  No identifiers are
made.

Merges cannot cross some places: no piece holds a word mark after another character, and
some characters are in no piece of several.  Texts are cut there, and the counts of short
chunks are kept in a bounded memo, which is exact because chunks are independent.  These
facts are read from the vocabulary, and a vocabulary without them is merged text by text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._worker import held

MARK = "▁"
#: Chunks kept in each of two generations, and the longest chunk kept, in one Python worker.
MEMO_CHUNKS, MEMO_CHARS = 300_000, 48


class MergeCounter:
    """Counts tokens under one sentencepiece byte-pair model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        special = [i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)]
        if len(special) == len(ids) or sum(model.is_byte(i) for i in ids) != 256:
            raise ValueError("a byte-pair model with byte fallback is needed")
        keep = set(ids) - set(special)
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in keep}
        self.dummy_prefix = model.encode("a", out_type=str)[0].startswith(MARK)
        several = [p for p in self.rank if len(p) > 1]
        joined = any(MARK in p.lstrip(MARK) for p in several)
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in several))
        single = f"|[{alone}]" if alone else ""
        self.cut = None if joined else re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{single}")
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, text: str) -> int:
        """Tokens of a normalised text, by popping pairs off a heap."""
        rank = self.rank
        symbol: list[str | None] = list(text)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] + symbol[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, len(symbol[i]) + len(symbol[i + 1])))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, right, length = heapq.heappop(heap)
            if symbol[left] is None or symbol[right] is None or after[left] != right or len(symbol[left]) + len(symbol[right]) != length:
                continue
            symbol[left] += symbol[right]
            symbol[right] = None
            merges += 1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                r = rank.get(symbol[left] + symbol[follow])
                if r is not None:
                    heapq.heappush(heap, (r, left, follow, len(symbol[left]) + len(symbol[follow])))
            ahead = before[left]
            if ahead >= 0:
                r = rank.get(symbol[ahead] + symbol[left])
                if r is not None:
                    heapq.heappush(heap, (r, ahead, left, len(symbol[ahead]) + len(symbol[left])))
        fallback = sum(len(s.encode()) - 1 for s in symbol if s is not None and s not in rank)
        return n - merges + fallback

    def chunks(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        return self.cut.findall(text) if self.cut else [text]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        memo = self.memo
        chunks = self.chunks(text)
        try:
            return sum(map(memo.__getitem__, chunks))
        except KeyError:
            pass
        total = 0
        for c in chunks:
            k = memo.get(c)
            if k is None:
                k = self.older.get(c)
                if k is None:
                    k = self.merged(c)
                if len(c) <= MEMO_CHARS:
                    if len(memo) >= MEMO_CHUNKS:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[c] = k
            total += k
        return total


def merge_counter(model_path: str) -> MergeCounter:
    return held(("counts", model_path), lambda: MergeCounter(model_path))


def token_counts(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Narrow: one pass, no shuffle.  A null text is empty; an empty text has no tokens; ids
    pass through as they are, null and repeated ones too; other columns of ``docs`` are
    neither read nor returned.
    """
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(model_path)
        for batch in batches:
            counts = pa.array([counter.count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
