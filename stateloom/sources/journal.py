"""Append-only journal segments: a decoder over ``binaryFile`` and an encoder for exports.

A segment is a header and frames of length, payload, checksum, length.  A frame whose
checksum or JSON is wrong is skipped; a torn tail ends its segment.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import encode_record_ref

LENGTH = struct.Struct(">Q")
MOST_BYTES = 64 << 20
SEGMENT_NAME = re.compile("[0-9a-z]{1,12}")
SCHEMA = "writer string, segment_name string, segment long, offset long, length long, checksum string, frame string"


def decode_segment(content: bytes, header: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(offset, length, checksum, JSON text) of the intact frames of one segment."""
    if not content.startswith(header):
        return
    at, end, width = len(header), len(content), LENGTH.size
    while at + width <= end:
        prefix = content[at : at + width]
        (length,) = LENGTH.unpack(prefix)
        stop = at + width + length
        if length > MOST_BYTES or stop + 32 + width > end or content[stop + 32 : stop + 32 + width] != prefix:
            return
        payload, checksum = content[at + width : stop], content[stop : stop + 32]
        if hashlib.sha256(prefix + payload).digest() == checksum:
            try:
                text = payload.decode()
                if isinstance(json.loads(text), dict):
                    yield at, length, checksum.hex(), text
            except ValueError:
                pass
        at = stop + 32 + width


def encode_segment(frames: Iterable[dict], header: bytes) -> bytes:
    """A segment of canonical JSON frames."""
    out = [header]
    for frame in frames:
        payload = json.dumps(frame, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
        prefix = LENGTH.pack(len(payload))
        out += [prefix, payload, hashlib.sha256(prefix + payload).digest(), prefix]
    return b"".join(out)


def read_journal(spark: SparkSession, root: str, header: bytes, suffix: str = ".hwj") -> DataFrame:
    """Frames of all ``root/<writer>/<segment><suffix>`` files, with their references.

    Segments are the unit of work, and their size is bounded by the writer's rotation.  The
    physical order of the log is (writer, segment_name, offset), by text of the file name.
    A segment's name is its number in base 36; other names are no segments.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                writer, name = path.rsplit("/", 2)[-2:]
                stem = name.removesuffix(suffix)
                if SEGMENT_NAME.fullmatch(stem):
                    rows += [(writer, name, int(stem, 36), *frame) for frame in decode_segment(content, header)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    frames = files.select("path", "content").mapInPandas(run, SCHEMA)
    ref = encode_record_ref(F.col("writer"), F.col("segment"), F.col("offset"), F.col("length"), F.col("checksum"))
    return frames.withColumn("record_ref", ref).withColumn("members", F.parse_json("frame"))


def physical_order() -> list:
    """Sort keys of the log's physical order; ``10.hwj`` comes before ``2.hwj``."""
    return [F.col("writer"), F.col("segment_name"), F.col("offset")]
