"""The resumable scan: windows, budgets, rotation, restarts and replays against a plain model."""

import json
import os

from stateloom.sources import marker_stream


def tree(root, sizes):
    """Folders r<i> with so many markers in two levels of folders, a.b beside a."""
    paths = []
    for i, n in enumerate(sizes):
        for k in range(n):
            folder = ("a", "a.b", "a/c", "d")[k % 4]
            path = f"r{i}/{folder}/m{k:03d}" + (".txt" if k % 7 == 6 else "")
            os.makedirs(os.path.dirname(root / path), exist_ok=True)
            (root / path).write_text("")
            paths.append(path)
    return paths


def in_order(paths):
    return sorted(paths, key=lambda p: p.split("/"))


def entries_of(paths):
    """Markers and folders, in the order of the scan."""
    below = {tuple(p.split("/")[:k]) for p in paths for k in range(2, p.count("/") + 2)}
    return ["/".join(e) for e in sorted(below)]


def window(reader, start):
    """(rows, end) of the window behind an offset, as its tasks read it."""
    end = json.loads(json.dumps(reader.advance(start)))
    return [r for p in reader.partitions(start, end) for r in reader.read(p)], end


def test_windows_visit_each_entry_once_a_cycle(tmp_path):
    paths = tree(tmp_path, [25, 3, 0, 9])
    (tmp_path / "r2").mkdir()
    for processing, discovery in ((4, 100), (100, 5), (3, 4), (1000, 1000), (1, 1)):
        reader = marker_stream.MarkerReader({"path": str(tmp_path), "processing": str(processing), "discovery": str(discovery), "name": r"m\d+"})
        offset, seen, finished = reader.initialOffset(), [], set()
        while len(finished) < 3:
            before = offset
            rows, offset = window(reader, before)
            rows = [p for _, p in rows]
            assert len(rows) <= processing
            new = [p for p in rows if p.split("/")[0] not in finished]
            seen += new
            finished |= {r for r, upto in offset["served"].items() if not upto and r != "r2"}
        want = [p for p in paths if not p.endswith(".txt")]
        assert sorted(seen) == sorted(want)
        for i in (0, 1, 3):
            assert [p for p in seen if p.startswith(f"r{i}/")] == in_order(p for p in want if p.startswith(f"r{i}/"))


def test_a_large_root_does_not_starve_a_small_one(tmp_path):
    tree(tmp_path, [200, 2])
    reader = marker_stream.MarkerReader({"path": str(tmp_path), "processing": "10", "discovery": "50"})
    offset, batches = reader.initialOffset(), []
    for _ in range(3):
        rows, offset = window(reader, offset)
        batches.append({r for r, _ in rows})
    assert batches == [{"r0"}, {"r1", "r0"}, {"r1", "r0"}]


def test_discovery_counts_folders_and_other_files(tmp_path):
    paths = tree(tmp_path, [30])
    reader = marker_stream.MarkerReader({"path": str(tmp_path), "processing": "1000", "discovery": "7", "name": r"m\d+"})
    entries, offset, got = entries_of(paths), reader.initialOffset(), []
    for _ in range(-(-len(entries) // 7)):
        before = len(got)
        rows, offset = window(reader, offset)
        got += [p for _, p in rows]
        visited = entries[7 * (offset["tick"] - 1) : 7 * offset["tick"]]
        assert got[before:] == [e for e in visited if e in paths and not e.endswith(".txt")]


def test_empty_and_vanished_folders(tmp_path):
    reader = marker_stream.MarkerReader({"path": str(tmp_path / "none")})
    start = reader.initialOffset()
    rows, end = window(reader, start)
    assert list(rows) == [] and end == start
    tree(tmp_path, [5])
    reader = marker_stream.MarkerReader({"path": str(tmp_path), "processing": "2"})
    _, offset = window(reader, reader.initialOffset())
    for f in sorted((tmp_path / "r0").rglob("*"), reverse=True):
        f.unlink() if f.is_file() else f.rmdir()
    rows, offset = window(reader, offset)
    assert list(rows) == [] and offset["cursors"] == {}


def test_a_stream_continues_behind_its_last_batch(spark, tmp_path):
    paths = tree(tmp_path / "in", [18, 15])
    out, batches = [], []

    def run(fails_at=None):
        def write(batch, batch_id):
            rows = [r.path for r in batch.collect()]
            if fails_at == batch_id:
                raise RuntimeError("killed")
            out.extend(rows)
            batches.append(batch_id)

        stream = marker_stream.scan_stream(spark, str(tmp_path / "in"), str(tmp_path / "c"), processing=6, discovery=100)
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            assert "killed" in str(e)

    run()  # each run is a restart: one window
    run(fails_at=1)
    run()  # the killed window again
    run()
    run()
    while len(batches) < 7:
        run()
    assert batches == list(range(7))
    # Each root's markers come in order, cycle after cycle: none is lost or repeated by a restart or a kill.
    for root in ("r0", "r1"):
        mine, cycle = [p for p in out if p.startswith(root)], in_order(p for p in paths if p.startswith(root))
        assert len(mine) >= len(cycle) and mine == (3 * cycle)[: len(mine)]
