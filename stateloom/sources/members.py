"""Lines of plain and compressed members, decoded in bounded pieces.

A member's bytes are fed to an incremental decoder that never gives out more than a piece at
a time, so what a worker holds is the compressed member, one piece and one batch of lines,
whatever the member decodes to.  Concatenated gzip, bzip2 and xz streams are one member.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of compressed members, in the order in which they stand in for a plain one (fixed values).
SUFFIXES = (".bz2", ".gz", ".xz")
_MAGIC = ((b"BZh", ".bz2"), (b"\x1f\x8b", ".gz"), (b"\xfd7zXZ\x00", ".xz"))
SCHEMA = "line_no long, part int, offset long, line string, error string"


def kind_of(content: bytes) -> str:
    """The suffix of the compression that the first bytes name; empty for a plain member."""
    return next((suffix for magic, suffix in _MAGIC if content.startswith(magic)), "")


def packed(content: bytes, suffix: str) -> bytes:
    """The bytes as a member of the compression that ``suffix`` names; as they are for an empty one.

    An xz dictionary is no longer than the content: writing with the usual 8 MB takes some 90 MB of memory.
    """
    if suffix == ".xz":
        return lzma.compress(content, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": max(4096, min(len(content), 8 << 20))}])
    return {"": bytes, ".bz2": bz2.compress, ".gz": gzip.compress}[suffix](content)


class _Gzip:
    """zlib's decoder with the interface of the other two."""

    def __init__(self):
        self._d = zlib.decompressobj(31)

    def decompress(self, data: bytes, most: int) -> bytes:
        return self._d.decompress(self._d.unconsumed_tail + data, most)

    needs_input = property(lambda self: not self._d.unconsumed_tail)
    eof = property(lambda self: self._d.eof)
    unused_data = property(lambda self: self._d.unused_data)


def decoded(content: bytes, piece: int = 1 << 16) -> Iterator[bytes]:
    """The member in pieces of at most ``piece`` bytes; damage raises once all that is intact has come out."""
    kind = kind_of(content)
    if not kind:
        for at in range(0, len(content), piece):
            yield content[at : at + piece]
        return
    make = {".bz2": bz2.BZ2Decompressor, ".gz": _Gzip, ".xz": lzma.LZMADecompressor}[kind]
    view, at = memoryview(content), 0
    while at < len(view):
        stream = make()
        while not stream.eof:
            fed = b""
            if stream.needs_input:
                if at >= len(view):
                    raise EOFError("the member ends inside a stream")
                fed = bytes(view[at : at + piece])
                at += len(fed)
            if out := stream.decompress(fed, piece):
                yield out
        at -= len(stream.unused_data)
        # Zeros may pad the end of a stream.
        while at < len(view) and view[at] == 0:
            at += 1
        if at < len(view) and kind_of(bytes(view[at : at + 8])) != kind:
            raise ValueError("bytes behind the last stream")


def _whole_characters(data: bytes) -> int:
    """The longest length that does not end inside a UTF-8 character."""
    for back in range(1, min(4, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 == 0x80:
            continue
        needs = 1 if byte < 0x80 else 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
        return len(data) if needs <= back else len(data) - back
    return len(data)


def lines_of(content: bytes, most_line: int, piece: int = 1 << 16) -> Iterator[tuple[int, int, int, str | None, str | None]]:
    """(line_no, part, offset, line, error): lines without their ends, offsets in decoded bytes.

    A line longer than ``most_line`` bytes comes in parts, cut between characters.  Bytes that
    are no UTF-8 become U+FFFD.  Damage gives what there is of the last line, then a row
    with the error.
    """
    held, begin, number, part, error = b"", 0, 0, 0, None

    def cut() -> Iterator[tuple]:
        nonlocal held, begin, part
        while len(held) > most_line:
            n = _whole_characters(held[:most_line]) or most_line
            yield number, part, begin, held[:n].decode(errors="replace"), None
            held, begin, part = held[n:], begin + n, part + 1

    pieces = decoded(content, piece)
    while True:
        try:
            data = next(pieces, None)
        except (OSError, EOFError, ValueError, zlib.error, lzma.LZMAError) as e:
            data, error = None, f"{type(e).__name__}: {e}"
        if data is None:
            break
        *ended, rest = data.split(b"\n")
        for line in ended:
            held += line
            yield from cut()
            yield number, part, begin, held.decode(errors="replace"), None
            begin, held, number, part = begin + len(held) + 1, b"", number + 1, 0
        held += rest
        yield from cut()
    if held:
        yield number, part, begin, held.decode(errors="replace"), None
        number += 1
    if error:
        yield number, 0, begin + len(held), None, error


def member_lines(members: DataFrame, keys: list[str], content: str = "content", *, opened: Callable[..., bytes] | None = None, most_line: int = 1 << 20, piece: int = 1 << 16, batch_chars: int = 4 << 20) -> DataFrame:
    """The lines of ``members``: its ``keys`` columns, line_no (from 0), part, offset, line, error.

    A null or empty member has no lines; an end of line at the end begins no other line.
    ``opened`` makes the member's bytes of its keys and ``content``, one member at a time in the
    worker that reads its lines, so a batch of them is never held.
    """
    picked = members.select(*keys, content).where(F.col(content).isNotNull())
    kinds = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in SCHEMA.split(", "))]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            size = 0

            def made() -> pa.RecordBatch:
                at = pa.array(owner, pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keys))], *columns], names=names)

            for i in range(batch.num_rows):
                member = batch.column(len(keys))[i].as_py()
                if opened:
                    member = opened(*[batch.column(k)[i].as_py() for k in range(len(keys))], member)
                for row in lines_of(member, most_line, piece):
                    rows.append(row)
                    owner.append(i)
                    size += len(row[3] or "") + 16
                    if size > batch_chars:
                        yield made()
                        rows, owner, size = [], [], 0
            if rows:
                yield made()

    return picked.mapInArrow(run, f"{kinds}, {SCHEMA}")


def read_members(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content")


def member_name(path: Column) -> Column:
    """A member's name without the suffix of its compression."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(bz2|gz|xz)$", "")


def preferred_members(members: DataFrame, path: str = "path") -> DataFrame:
    """One file of each member of a folder: the plain one, else the compressed one that comes first in SUFFIXES.

    ``folder`` and ``name`` are added.  Only paths are compared.
    """
    rank = F.coalesce(*[F.when(F.col(path).endswith(s), i + 1) for i, s in enumerate(SUFFIXES)], F.lit(0))
    named = members.withColumn("folder", F.regexp_replace(path, "/[^/]*$", "")).withColumn("name", member_name(F.col(path)))
    best = named.groupBy("folder", "name").agg(F.min_by(path, F.struct(rank, F.col(path))).alias("_best")).select(F.col("_best").alias(path))
    return named.join(best, path, "left_semi")
