"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary is a file of byte strings with ranks.  Every byte is mapped to a printable
character, so that the library, which merges characters, can merge bytes.  Its merge list is
read off the ranks: a token's merge is the last one that makes it when its own bytes are
merged by rank, and a piece that is a token as a whole is taken as it stands.

Texts are split by a pattern whose classes (white space, letters, numbers) are spelled out
as the rank library's own engine sees them, as engines differ in their Unicode versions.
Pieces are independent, so the ids of short ones stay in a bounded memo and only new ones go
to the library.

Decoding maps the tokens' characters back to bytes.  A character's bytes may lie in several
tokens: offsets name every character that a token has a byte of, and a text decoder holds
bytes back until their character is whole.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._worker import held

#: Pieces kept in each of two generations, and the longest piece kept, in one Python worker.
MEMO_PIECES, MEMO_CHARS = 150_000, 48
#: New pieces that go to the library at once, and characters of them, or bytes of texts in one batch that goes out.
BATCH_PIECES, BATCH_CHARS = 4096, 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge, by rank and from the left, makes the token; None if none does."""
    parts, made = [bytes([b]) for b in token], None
    while len(parts) > 1:
        found = [(ranks[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in ranks]
        if not found:
            return None
        _, i = min(found)
        made = parts[i], parts[i + 1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return made


def _class_points(pattern: str) -> np.ndarray:
    """The code points that the rank library's engine matches with a one-character pattern."""
    import tiktoken

    bytes_only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return np.array([*map(ord, bytes(bytes_only.encode_ordinary(every)).decode())])


def _as_ranges(points: np.ndarray) -> str:
    edges = np.flatnonzero(np.diff(points) != 1)
    first, last = points[np.append(0, edges + 1)], points[np.append(edges, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist()))


#: The last code points of texts that have a form of the pattern of their own; shorter classes are matched faster.
WIDTHS = (0x7F, 0xFFFF, 0x10FFFF)


def spelled_out(pattern: str, classes: dict[str, np.ndarray], most: int) -> re.Pattern[str]:
    """``pattern`` with its classes (\\s, \\S, \\p{L}, \\p{N}, also inside brackets) as explicit ranges, for texts up to code point ``most``."""
    ranges = {name: _as_ranges(points[points <= most]) for name, points in classes.items()}

    def spell(found: re.Match[str]) -> str:
        text = found[0]
        if text == r"\S":
            return f"[^{ranges[chr(92) + 's']}]"
        if text in ranges:
            return f"[{ranges[text]}]"
        for name, spelled in ranges.items():
            text = text.replace(name, spelled)
        return text

    return re.compile(re.sub(r"\[[^\]]*\]|\\s|\\S|\\p\{[LN]\}", spell, pattern))


def read_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Encoder:
    """Ids of texts as packed 32-bit little-endian bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(ranks_path)
        #: From a byte, read as Latin-1, to its character.
        self.to_characters = dict(enumerate(byte_characters()))
        mapped = {token: self.mapped(token) for token in ranks}
        by_rank = sorted(ranks, key=ranks.__getitem__)
        merges = [tuple(mapped[p] for p in pair) for token in by_rank if len(token) > 1 and (pair := last_merge(token, ranks))]
        self.library = Tokenizer(models.BPE(vocab={mapped[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        # No byte is mapped to a space, so spaces can part pieces.
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        classes = {name: _class_points(name) for name in (r"\s", r"\p{L}", r"\p{N}")}
        self.patterns = [spelled_out(pattern, classes, most) for most in WIDTHS]
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[[*ranks.values()]] = [*map(len, ranks)]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.to_characters)

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches from left to right."""
        wide = 0 if text.isascii() else 1 if len(text.encode("utf-16-le")) == 2 * len(text) else 2
        return self.patterns[wide].findall(text)

    def _encoded(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of pieces, by the library, some at a time."""
        at = 0
        while at < len(pieces):
            end, chars = at, 0
            while end < len(pieces) and end - at < BATCH_PIECES and (end == at or chars < BATCH_CHARS):
                chars += len(pieces[end])
                end += 1
            made = self.library.encode(" ".join([self.mapped(p.encode()) for p in pieces[at:end]]), add_special_tokens=False)
            ids, owner = np.array(made.ids, "<u4").tobytes(), np.array(made.word_ids, np.int64)
            begins = (4 * np.searchsorted(owner, np.arange(end - at + 1))).tolist()
            for i, j in zip(begins, begins[1:]):
                yield ids[i:j]
            at = end

    def encode(self, text: str) -> bytes:
        memo, pieces = self.memo, self.pieces(text)
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            pass
        older, new = self.older, []
        for p in dict.fromkeys(pieces):
            if p not in memo:
                if p in older:
                    memo[p] = older[p]
                else:
                    new.append(p)
        memo.update(zip(new, self._encoded(new), strict=True))
        out = b"".join([memo[p] for p in pieces])
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        if len(memo) >= MEMO_PIECES:
            self.older, self.memo = memo, {}
        return out

    def offsets(self, ids: bytes, text: str) -> np.ndarray:
        """(first character, end) of each token's characters, in code points; a split character is in several tokens."""
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        begins = np.append(0, ends[:-1])[: len(ends)]
        opens = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        count = np.cumsum(opens)
        return np.stack([count[begins] - 1, count[ends - 1]], axis=1).astype("<u4") if len(ends) else np.zeros((0, 2), "<u4")


class Decoder:
    """Bytes of ids: each token's characters by the reversed byte table."""

    def __init__(self, ranks_path: str):
        ranks = read_ranks(ranks_path)
        characters = byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        self.token_bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            text = "".join([characters[b] for b in token])  # as the library names the token
            self.token_bytes[i] = bytes([to_byte[c] for c in text])

    def decode(self, ids: bytes) -> bytes:
        """The tokens' bytes; an id outside the vocabulary is an error."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode_pieces(self, parts: Iterable[bytes]) -> Iterator[str]:
        """The text of ids that come in parts: a character split between parts comes out with the later one.

        Bytes that are no UTF-8 become U+FFFD.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(self.decode(ids))
        if rest := decoder.decode(b"", final=True):
            yield rest


def encoder(ranks_path: str, pattern: str) -> Encoder:
    return held(("byte level", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))


def decoder(ranks_path: str) -> Decoder:
    return held(("byte table", ranks_path), lambda: Decoder(ranks_path))


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about BATCH_CHARS bytes in column ``at``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy())
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + BATCH_CHARS, side="right")))
        yield batch.slice(row, end - row)
        row = end


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids and offsets (binary).

    ids holds a text's ids as little-endian unsigned 32-bit integers, offsets the first
    character of each token and the end behind its last, in code points, in the same form.
    Strings of special tokens are ordinary text.  A null text is empty, an empty text has no
    ids; ids of rows pass through, null and repeated ones too; other columns of ``docs`` are
    neither read nor returned.  Narrow: one pass, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = encoder(ranks_path, pattern)
        for batch in batches:
            for part in _slices(batch, 1):
                ids, offsets = [], []
                for text in part.column(1).to_pylist():
                    ids.append(level.encode(text))
                    offsets.append(level.offsets(ids[-1], text).tobytes())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())], names=[id_col, "n_tokens", "ids", "offsets"])

    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, offsets binary")


def decode_ids(encoded: DataFrame, ranks_path: str, *, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` and the bytes of their ids, ``decoded_col`` (binary); null ids give null.

    The bytes are those of the tokens, whole characters or not; a column of that name is
    replaced, all others are kept.  ``F.decode(decoded, "UTF-8")`` is the text.
    """
    columns = [c for c in encoded.columns if c.lower() != decoded_col.lower()]
    kept = encoded.select(*columns)
    at = columns.index(ids_col)
    schema = kept.withColumn(decoded_col, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoder(ranks_path)
        for batch in batches:
            for part in _slices(batch, at):
                decoded = [None if ids is None else table.decode(ids) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)
