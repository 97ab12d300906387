"""Collector programs: one long-lived process a partition, fed and read under limits.

The program first says that it is ready, then gets one JSON line per record and answers each
with a line, in any order.  No more than ``window`` records are unanswered at a time, and
neither pipe is written or read further than that allows, so a slow program slows its task
and a talkative one fills no memory.  An answer that is too long, or does not come in time,
costs the records at hand, not the task: they are kept with an error, and the program is
started again for the others, up to a number of times.
"""

from __future__ import annotations

import json
import os
import selectors
import subprocess
import time
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a program's first line says, besides what else it likes (fixed value).
READY = {"ready": 1}
_READ = 1 << 16


@dataclass(frozen=True)
class Limits:
    window: int = 64
    line_bytes: int = 1 << 20
    start_seconds: float = 30.0
    answer_seconds: float = 60.0
    restarts: int = 3
    stderr_bytes: int = 4096


class Failed(Exception):
    """The program cannot be used further."""


class Program:
    """One process and its pipes; ``ask`` gives each record's answer as it comes."""

    def __init__(self, argv: Sequence[str], limits: Limits):
        self.argv, self.limits = list(argv), limits
        self.process: subprocess.Popen | None = None
        self.starts = 0

    def __enter__(self) -> Program:
        return self

    def __exit__(self, *_) -> None:
        self.stop()

    def _start(self) -> None:
        if self.starts > self.limits.restarts:
            raise Failed("the program was started too often")
        self.starts += 1
        self.process = subprocess.Popen(self.argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True)
        self.said, self.errors, self.unsent = b"", b"", b""
        self.pipes = selectors.DefaultSelector()
        for pipe, name in ((self.process.stdout, "out"), (self.process.stderr, "err")):
            os.set_blocking(pipe.fileno(), False)
            self.pipes.register(pipe, selectors.EVENT_READ, name)
        os.set_blocking(self.process.stdin.fileno(), False)
        first = self._line(time.monotonic() + self.limits.start_seconds, "was not ready")
        try:
            ready = json.loads(first)
        except ValueError:
            ready = None
        if not isinstance(ready, dict) or any(ready.get(k) != v for k, v in READY.items()):
            raise Failed(f"expected {json.dumps(READY)} first")

    def stop(self) -> None:
        """Ends the process and closes its pipes."""
        if self.process is None:
            return
        process, self.process = self.process, None
        self.pipes.close()
        if process.poll() is None:
            process.kill()
        process.wait()
        for pipe in (process.stdin, process.stdout, process.stderr):
            try:
                pipe.close()
            except BrokenPipeError:
                pass

    def _last_words(self, otherwise: str) -> str:
        return (self.errors.decode(errors="replace").strip().splitlines() or [otherwise])[-1]

    def _pump(self, until: float) -> None:
        """Writes and reads what the pipes take and hold now, waiting for either until then."""
        events = self.pipes.select(max(0.0, until - time.monotonic()))
        for key, _ in events:
            if key.data == "in":
                try:
                    self.unsent = self.unsent[os.write(key.fd, self.unsent[:_READ]) :]
                except BrokenPipeError:
                    self.unsent = b""
                if not self.unsent:
                    self.pipes.unregister(key.fileobj)
                continue
            data = os.read(key.fd, _READ)
            if not data:
                self.pipes.unregister(key.fileobj)
                if key.data == "out":
                    self.ended = True
            elif key.data == "out":
                self.said += data
            else:
                self.errors = (self.errors + data)[-self.limits.stderr_bytes :]

    def _send(self, line: bytes) -> None:
        if not self.unsent:
            self.pipes.register(self.process.stdin, selectors.EVENT_WRITE, "in")
        self.unsent += line

    ended = False

    def _line(self, until: float, what: str) -> bytes:
        """The next line of the program."""
        while True:
            line, end, rest = self.said.partition(b"\n")
            if len(line) > self.limits.line_bytes:
                raise Failed(f"a line of more than {self.limits.line_bytes} bytes")
            if end:
                self.said = rest
                return line
            if self.ended:
                # Its last words may still be in the pipe.
                deadline = time.monotonic() + 1.0
                while self.process.stderr in [k.fileobj for k in self.pipes.get_map().values()] and time.monotonic() < deadline:
                    self._pump(deadline)
                code = self.process.wait()
                raise Failed(self._last_words(f"exit code {code}"))
            if time.monotonic() >= until:
                raise Failed(f"the program {what} in time")
            self._pump(until)

    def ask(self, records: Sequence[tuple[object, str]]) -> dict[object, dict]:
        """Answers by key: ``{"outputs": ...}`` or ``{"error": ...}``; every key has one."""
        todo, out, waiting = OrderedDict(records), {}, OrderedDict()
        while todo or waiting:
            try:
                if self.process is None:
                    self.ended = False
                    self._start()
                while todo and len(waiting) < self.limits.window and len(self.unsent) < _READ:
                    key, record = todo.popitem(last=False)
                    self._send(record.encode() + b"\n")
                    waiting[key] = time.monotonic()
                # The one that has waited longest bounds the wait.
                until = (next(iter(waiting.values())) if waiting else time.monotonic()) + self.limits.answer_seconds
                answer = self._answer(self._line(until, "did not answer"))
                if answer is not None and answer[0] in waiting:
                    waiting.pop(answer[0])
                    out[answer[0]] = answer[1]
                    # Time runs anew for those that waited behind an answered one.
                    for k in waiting:
                        waiting[k] = max(waiting[k], time.monotonic() - self.limits.answer_seconds / 2)
            except Failed as e:
                self.stop()
                if self.starts > self.limits.restarts:
                    waiting.update(todo)
                    todo.clear()
                out |= {k: {"error": str(e)} for k in waiting}
                waiting.clear()
        return out

    @staticmethod
    def _answer(line: bytes) -> tuple[object, dict] | None:
        """(key, answer); None for a line that is no answer."""
        try:
            made = json.loads(line)
            return made["key"], {k: made[k] for k in ("outputs", "error") if k in made}
        except (ValueError, KeyError, TypeError):
            return None


def run_program(records: DataFrame, argv: Sequence[str], key: str = "job_id", limits: Limits = Limits()) -> DataFrame:
    """A collector program over records: (key, outputs as JSON text, error), one row per record.

    Keys are unique.  Each record is sent as ``{"key": ..., "record": {...}}``; an answer is
    ``{"key": ..., "outputs": {...}}`` or ``{"key": ..., "error": "..."}``.  Lines that answer
    nothing are passed over.  A record without an answer is kept with the reason: the
    program's last error line, its exit code, or the limit that it broke.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Program(argv, limits) as program:
            for batch in batches:
                answers = program.ask(list(zip(batch[key].tolist(), batch["record"])))
                made = [answers[k] for k in batch[key].tolist()]
                outputs = [None if a.get("outputs") is None else json.dumps(a["outputs"], sort_keys=True) for a in made]
                yield pd.DataFrame({key: batch[key], "outputs": outputs, "error": [a.get("error") for a in made]})

    named = records.select(key, F.to_json(F.struct(F.col(key).alias("key"), F.struct("*").alias("record"))).alias("record"))
    return named.mapInPandas(run, f"{key} {kind}, outputs string, error string")
