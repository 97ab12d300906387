"""A sink that appends frames to journals: segments are staged by tasks and published by one commit.

A task writes whole segments below ``_staging`` and reports them; only the commit, on the
driver's side, gives them their numbers.  It first records the moves in a numbered manifest,
created exclusively, then links each segment into place.  So a task that dies or runs twice
leaves nothing that a reader sees, two commits cannot take one number, and a commit that
dies half-way is finished by the next one (``recover``).  A manifest also carries the last
version of each application, so a batch that is replayed is not appended again.

Segments go to a folder that the driver and all executors mount under one path; links and
exclusive creation are those of POSIX file systems.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .journal import LENGTH, MOST_BYTES

STAGING, COMMITS = "_staging", "_commits"
#: A manifest and the one before it are kept.
KEPT_MANIFESTS = 2
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n: int) -> str:
    out = ""
    while True:
        n, digit = divmod(n, 36)
        out = _DIGITS[digit] + out
        if not n:
            return out


def encode_frame(text: str) -> bytes:
    """One frame from the JSON text of an object, in canonical form."""
    record = json.loads(text)
    if not isinstance(record, dict):
        raise ValueError("a frame is a JSON object")
    payload = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    if len(payload) > MOST_BYTES:
        raise ValueError(f"a frame of {len(payload)} bytes is too long")
    length = LENGTH.pack(len(payload))
    return length + payload + hashlib.sha256(length + payload).digest() + length


@dataclass
class Staged(WriterCommitMessage):
    """The segments of one task in their order: (writer, path, frames)."""

    partition: int
    segments: list[tuple[str, str, int]]


def _synced(path: str) -> None:
    at = os.open(path, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


class _Segments:
    """Whole segments of a task, one open at a time; a new one when the writer changes or it is full."""

    def __init__(self, folder: str, header: bytes, most: int):
        self.folder, self.header, self.most = folder, header, most
        self.out: list[tuple[str, str, int]] = []
        self.writer, self.file, self.frames = None, None, 0

    def add(self, writer: str, frame: bytes) -> None:
        if self.writer != writer or self.file.tell() + len(frame) > self.most:
            self.close()
            os.makedirs(self.folder, exist_ok=True)
            self.writer = writer
            self.file = open(f"{self.folder}/{len(self.out):06d}", "xb")  # noqa: SIM115
            self.file.write(self.header)
        self.file.write(frame)
        self.frames += 1

    def close(self) -> None:
        if self.file:
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()
            self.out.append((self.writer, self.file.name, self.frames))
        self.writer, self.file, self.frames = None, None, 0


class _Sink:
    """What the batch and the stream writer share; it travels to tasks by pickle."""

    def __init__(self, options: dict[str, str]):
        self.root = local_path(options["path"])
        self.header = bytes.fromhex(options["header"])
        self.suffix = options.get("suffix", ".hwj")
        self.most = int(options.get("mostBytes", 64 << 20))
        self.application = options.get("application")
        self.version = int(options["version"]) if "version" in options else None
        self.write_id = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        segments = _Segments(f"{self.root}/{STAGING}/{self.write_id}/{partition:06d}-{uuid.uuid4().hex}", self.header, self.most)
        for row in rows:
            if str(uuid.UUID(row["writer"])) != row["writer"]:
                raise ValueError(f"{row['writer']!r} is not a canonical UUID")
            segments.add(row["writer"], encode_frame(row["frame"]))
        segments.close()
        return Staged(partition, segments.out)

    def publish(self, messages: Sequence[Staged | None], version: int | None) -> None:
        staged = [(w, p) for m in sorted((m for m in messages if m), key=lambda m: m.partition) for w, p, _ in m.segments]
        publish(self.root, staged, self.suffix, self.application, version)
        self.discard()

    def discard(self) -> None:
        """What this write has staged and not published, attempts that lost included."""
        shutil.rmtree(f"{self.root}/{STAGING}/{self.write_id}", ignore_errors=True)


class _BatchWriter(_Sink, DataSourceWriter):
    def commit(self, messages: list[Staged | None]) -> None:
        self.publish(messages, self.version)

    def abort(self, messages: list[Staged | None]) -> None:
        self.discard()


class _StreamWriter(_Sink, DataSourceStreamWriter):
    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self.discard()


class JournalSink(DataSource):
    """``format("journal")``: rows (writer, frame) appended to the journals below ``path``.

    Options: ``header`` (hex), ``mostBytes`` and ``suffix`` of segments; ``application`` and
    ``version``, a rising number, make a write happen once.  A stream's versions are its
    batch numbers, so a stream needs only ``application``.
    """

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return "writer string, frame string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a journal can only be appended to")
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if "application" not in self.options:
            raise ValueError("a stream to a journal needs an application name")
        return _StreamWriter(self.options)


def local_path(path: str) -> str:
    if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*:", path):
        raise ValueError(f"journals need a mounted folder, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/")


def _manifests(root: str) -> list[tuple[int, str]]:
    with contextlib.suppress(FileNotFoundError):
        return sorted((int(n[:-5]), f"{root}/{COMMITS}/{n}") for n in os.listdir(f"{root}/{COMMITS}") if re.fullmatch(r"\d{12}\.json", n))
    return []


def _apply(manifest: dict) -> None:
    """Links each staged segment into place; a move that was made before is left as it is."""
    folders = set()
    for staged, final in manifest["moves"]:
        os.makedirs(os.path.dirname(final), exist_ok=True)
        folders.add(os.path.dirname(final))
        with contextlib.suppress(FileExistsError, FileNotFoundError):
            os.link(staged, final)
        if not os.path.exists(final):
            raise FileNotFoundError(f"{staged} is gone and {final} was never published")
    for folder in folders:
        _synced(folder)


def recover(root: str) -> dict:
    """Finishes the last commit, if it was not, and returns its manifest (empty without one)."""
    found = _manifests(root)
    if not found:
        return {"number": 0, "moves": [], "applications": {}}
    with open(found[-1][1], encoding="utf-8") as f:
        manifest = json.load(f)
    _apply(manifest)
    for _, path in found[:-KEPT_MANIFESTS]:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)
    return manifest


def _next_segment(folder: str, suffix: str) -> int:
    with contextlib.suppress(FileNotFoundError):
        return max((int(n.removesuffix(suffix), 36) + 1 for n in os.listdir(folder) if re.fullmatch("[0-9a-z]+" + re.escape(suffix), n)), default=0)
    return 0


def publish(root: str, staged: Sequence[tuple[str, str]], suffix: str, application: str | None, version: int | None) -> bool:
    """Numbers and publishes staged segments (writer, path); False if this version was published before."""
    while True:
        last = recover(root)
        done = last["applications"].get(application, -1) if application else -1
        if application and version is not None and version <= done:
            return False
        if not staged and not application:
            return True
        following: dict[str, int] = {}
        moves = []
        for writer, path in staged:
            folder = f"{root}/{writer}"
            n = following.get(writer)
            n = _next_segment(folder, suffix) if n is None else n
            following[writer] = n + 1
            moves.append([path, f"{folder}/{base36(n)}{suffix}"])
        applications = last["applications"] | ({application: version} if application and version is not None else {})
        manifest = {"number": last["number"] + 1, "moves": moves, "applications": applications}
        os.makedirs(f"{root}/{COMMITS}", exist_ok=True)
        draft = f"{root}/{COMMITS}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, f"{root}/{COMMITS}/{manifest['number']:012d}.json")
        except FileExistsError:
            continue  # another commit took the number: look again
        finally:
            os.unlink(draft)
        _synced(f"{root}/{COMMITS}")
        _apply(manifest)
        return True


def append_journal(
    frames: DataFrame,
    root: str,
    header: bytes,
    order: Sequence[Column | str],
    *,
    most_bytes: int = 64 << 20,
    suffix: str = ".hwj",
    application: str | None = None,
    version: int | None = None,
    partitions: int | None = None,
) -> None:
    """Appends (writer, frame) rows; a writer's frames come in ``order``, over as many tasks as they fill.

    Rows are dealt by ranges of writer and order, so one writer with most of the frames is
    no single task, and segments are numbered in the order of the ranges.
    """
    spark: SparkSession = frames.sparkSession
    spark.dataSource.register(JournalSink)
    keys = [F.col("writer"), *order]
    dealt = frames.repartitionByRange(partitions, *keys) if partitions else frames.repartitionByRange(*keys)
    options = {"header": header.hex(), "mostBytes": str(most_bytes), "suffix": suffix}
    if application is not None:
        options |= {"application": application, "version": str(version)}
    dealt.sortWithinPartitions(*keys).select("writer", "frame").write.format("journal").mode("append").options(**options).save(root)
