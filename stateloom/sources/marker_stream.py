"""A bounded, fair scan of marker folders as a stream: its offsets are the cursors.

A micro-batch is one window of the scan.  Roots (the folders below ``path``) are served in
rotation, each from behind its cursor and in the order of their paths, component by
component, until a window has visited ``discovery`` new entries or returned ``processing``
markers.  The offset holds the cursor of every root that was not read to its end, the root
that comes next, and where each root's window ended, so a restarted query continues behind
the last batch, and a batch that is run again reads its own window again.

The driver only finds where a window ends, which the two budgets bound; tasks list the
window, one root each, and what the markers say is parsed by columns
(``records.markers_from_paths``).  A new reader is not told where its query stopped, so it
looks up the newest entry of the query's own offset log.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Markers' names; other files are visited but not returned.
NAME = r".+"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def logged_offset(checkpoint: str | None) -> dict | None:
    """The newest offset that a query with this checkpoint has logged for its one source."""
    if not checkpoint:
        return None
    files, base = _opened(checkpoint)
    batches = [int(n) for n, is_folder in _listed(files, f"{base}/offsets") if n.isdigit() and not is_folder]
    if not batches:
        return None
    with files.open_input_stream(f"{base}/offsets/{max(batches)}") as f:
        # A version, the batch's metadata, then a line for each source.
        return json.loads(f.read().decode().splitlines()[2])


def _listed(files, folder: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of a folder's entries by name; a folder that has gone is empty."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((f.base_name, f.type == fs.FileType.Directory) for f in found)


def walked(files, folder: str, after: tuple[str, ...] | None, at: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], bool]]:
    """(path below the folder, is a folder) behind ``after``, parents before what they hold; passed folders are not listed."""
    for name, is_folder in _listed(files, folder):
        here = (*at, name)
        if after is None or here > after:
            yield here, is_folder
        if is_folder and (after is None or here >= after[: len(here)]):
            yield from walked(files, f"{folder}/{name}", after, here)


@dataclass
class Window(InputPartition):
    """Entries of one root behind ``after`` (None: from its begin) and up to ``upto`` (empty: to its end)."""

    root: str
    after: str | None
    upto: str


class MarkerReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.checkpoint = options["path"], options.get("checkpoint")
        self.processing, self.discovery = int(options.get("processing", 1000)), int(options.get("discovery", 10_000))
        self.name = options.get("name", NAME)
        self.chosen = [r for r in options.get("roots", "").split(",") if r]
        self.current: dict | None = None

    def roots(self, files, base: str) -> list[str]:
        return sorted(self.chosen) or [n for n, is_folder in _listed(files, base) if is_folder]

    def initialOffset(self) -> dict:
        return {"tick": 0, "next": "", "cursors": {}, "served": {}}

    def latestOffset(self) -> dict:
        if self.current is None:
            self.current = logged_offset(self.checkpoint) or self.initialOffset()
        self.current = self.advance(self.current)
        return self.current

    def advance(self, start: dict) -> dict:
        """The end of the window behind ``start``; the same offset where there is no entry at all."""
        files, base = _opened(self.path)
        is_marker = re.compile(self.name).fullmatch
        roots = self.roots(files, base)
        cursors = {r: c for r, c in start["cursors"].items() if r in roots}
        first = bisect_left(roots, start["next"]) % len(roots) if roots else 0
        taken, visited, served, last = 0, 0, {}, None
        for root in roots[first:] + roots[:first]:
            if taken >= self.processing or visited >= self.discovery:
                break
            last, reached = root, None
            for place, is_folder in walked(files, f"{base}/{root}", self._place(cursors.get(root))):
                visited += 1
                reached = "/".join(place)
                taken += not is_folder and is_marker(place[-1]) is not None
                if taken >= self.processing or visited >= self.discovery:
                    break
            else:
                # Read to its end: the next cycle starts it anew.
                cursors.pop(root, None)
                served[root] = ""
                continue
            cursors[root] = served[root] = reached
        if not visited:
            # Nothing behind the cursors.  If there were some, the next window starts a new cycle.
            return {**start, "cursors": {}, "served": {}, "tick": start["tick"] + 1} if start["cursors"] else start
        following = roots[(roots.index(last) + 1) % len(roots)]
        return {"tick": start["tick"] + 1, "next": following, "cursors": cursors, "served": served}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        """The windows that ``end`` closes.  The first call of a reader may be for a batch that is run again."""
        if self.current is None:
            self.current = end
        return [Window(root, start["cursors"].get(root), upto) for root, upto in end["served"].items()] if start != end else []

    def read(self, partition: Window) -> Iterator[tuple]:
        files, base = _opened(self.path)
        is_marker = re.compile(self.name).fullmatch
        for place, is_folder in walked(files, f"{base}/{partition.root}", self._place(partition.after)):
            if partition.upto and place > self._place(partition.upto):
                return
            if not is_folder and is_marker(place[-1]):
                yield partition.root, f"{partition.root}/{'/'.join(place)}"

    @staticmethod
    def _place(path: str | None) -> tuple[str, ...] | None:
        return tuple(path.split("/")) if path else None


class MarkerSource(DataSource):
    """``format("markers")``: a stream of (root, path) from the folders below ``path``.

    Options: ``processing`` and ``discovery``, the budgets of a window; ``name``, a pattern
    of markers' file names; ``roots``, a comma-separated choice of folders; ``checkpoint``,
    the query's checkpoint location, without which a restart begins anew.
    """

    @classmethod
    def name(cls) -> str:
        return "markers"

    def schema(self) -> str:
        return "root string, path string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return MarkerReader(self.options)


def scan_stream(spark: SparkSession, path: str, checkpoint: str, *, processing: int = 1000, discovery: int = 10_000, name: str = NAME, roots: str = "") -> DataFrame:
    """The endless scan as a stream, one window a batch; ``checkpoint`` is the location that the query is started with."""
    spark.dataSource.register(MarkerSource)
    options = {"processing": str(processing), "discovery": str(discovery), "name": name, "roots": roots, "checkpoint": checkpoint}
    return spark.readStream.format("markers").options(**options).load(path)
