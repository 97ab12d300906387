"""Digests of trees: globs, empty folders, special entries, very full folders, and where changes show."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from stateloom import queries
from stateloom.operators import merkle

SCHEMA = "tree string, path string, type string, size long, sha256 string, target string"


def digests(spark, rows, exclude=()):
    return {(r.tree, r.path): (r.kind, r.digest, r.n_files, r.bytes) for r in merkle.tree_digests(spark.createDataFrame(rows, SCHEMA), exclude).collect()}


FILES = [("t", "a/b/c.txt", "file", 3, "h1", None), ("t", "a/d", "symlink", None, None, "b"), ("t", "e", "file", 5, "h2", None), ("t", "a/empty", "directory", None, None, None)]


def test_folders_are_folded_from_their_leaves(spark):
    got = digests(spark, FILES)
    assert set(got) == {("t", p) for p in ("", "a", "a/b", "a/b/c.txt", "a/d", "a/empty", "e")}
    assert got["t", ""][2:] == (3, 8) and got["t", "a"][2:] == (2, 3) and got["t", "a/empty"][2:] == (0, 0)
    moved = digests(spark, [(t, f"x/y/{p}", *rest) for t, p, *rest in FILES])
    assert moved["t", "x/y/a"] == got["t", "a"] and moved["t", "x/y"] == got["t", ""]
    named = digests(spark, [*FILES, ("t", "a", "directory", None, None, None), ("t", "a/b", "directory", None, None, None)])
    assert named == got
    assert digests(spark, []) == {}


def test_a_change_shows_along_its_path_only(spark):
    old = merkle.tree_digests(spark.createDataFrame(FILES, SCHEMA))
    for changed, want in (
        ([("t", "a/b/c.txt", "file", 3, "h9", None), *FILES[1:]], {("a/b/c.txt", "changed"), ("a/b", "changed"), ("a", "changed"), ("", "changed")}),
        (FILES[1:], {("a/b/c.txt", "removed"), ("a/b", "removed"), ("a", "changed"), ("", "changed")}),
        ([*FILES, ("t", "e2/f", "file", 0, "h", None)], {("e2/f", "added"), ("e2", "added"), ("", "changed")}),
        (FILES, set()),
    ):
        new = merkle.tree_digests(spark.createDataFrame(changed, SCHEMA))
        assert {(r.path, r.change) for r in merkle.changed_paths(old, new).collect()} == want


def test_exclusions_take_all_below_them(spark):
    assert set(digests(spark, FILES, ["a/b"])) == {("t", p) for p in ("", "a", "a/d", "a/empty", "e")}
    assert set(digests(spark, FILES, ["a", "*.tmp"])) == {("t", ""), ("t", "e")}
    assert digests(spark, FILES, ["*"]) == {}
    with pytest.raises(Exception, match="special file system entry"):
        digests(spark, [("t", "p", "socket", None, None, None)])


def test_globs_match_as_whole_paths(spark):
    names = ["a", "ab", "a/b", "a/b.txt", "x[1]", "x1", "x-", "^", "a\nb", "a.b", "aXb", "", "\\", "a&&b"]
    for pattern in ["*", "a*", "?", "a?b", "x[[]1]", "x[0-9]", "x[!0-9]", "[^]", "*.txt", "a.b", "[", "a[", "\\", "[a-c&&b]", "[]]"]:
        rows = spark.createDataFrame([(n,) for n in names], "n string")
        got = {r.n for r in rows.where(F.col("n").rlike(merkle.glob_rule(pattern))).collect()}
        assert got == {n for n in names if fnmatch.fnmatchcase(n, pattern)}, pattern


def test_a_very_full_folder_is_folded_in_buckets(spark):
    rows = spark.range(100_000).select(F.lit("t").alias("tree"), F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"), F.lit("h").alias("sha256"), F.lit(None).cast("string").alias("target"))
    got = merkle.tree_digests(rows).where("kind = 'directory'").collect()
    assert sorted((r.path, r.n_files, r.bytes) for r in got) == [("", 100_000, 100_000), ("f", 100_000, 100_000)]
    again = merkle.tree_digests(rows.repartition(7)).where("path = ''").first()
    assert again.digest == next(r.digest for r in got if r.path == "")


def test_levels_are_one_plan_with_narrow_shuffles(spark, monkeypatch):
    made, write = [], merkle.scratch_table
    monkeypatch.setattr(merkle, "scratch_table", lambda df: made.append(df) or write(df))
    rows = spark.createDataFrame(FILES, SCHEMA)
    want = {(r.path, r.digest) for r in merkle.tree_digests(rows).collect()}
    assert not made  # entries and folders of a shallow tree are never written
    monkeypatch.setattr(merkle, "FULL", 0)  # as if every folder were very full
    assert {(r.path, r.digest) for r in merkle.tree_digests(rows).collect()} == want
    monkeypatch.setattr(merkle, "LEVELS_A_PLAN", 2)
    assert {(r.path, r.digest) for r in merkle.tree_digests(rows).collect()} == want and made
    path = "a/b/c/d/e/f"
    got = digests(spark, [("t", path, "file", 3, "h1", None), ("t", "a/x", "directory", None, None, None)])
    assert set(got) == {("t", path[: 2 * i + 1]) for i in range(6)} | {("t", ""), ("t", "a/x")}


def test_exclusions_hold_at_each_folder_above(spark):
    names = ["a/b/c", "ab/c", "a", "b/a/c", "a\nb/c", "x5/tmp/f", "x5/tmpf", "", "q/x5/tmp"]
    for pattern in ["a", "*5/tmp", "a/b", "?", "a*", "", "[ab]", "*/c"]:
        rows = spark.createDataFrame([(n,) for n in names], "n string")
        got = {r.n for r in rows.where(merkle.included(F.col("n"), [pattern])).collect()}
        parts = lambda n: ["/".join(n.split("/")[:i]) for i in range(1, n.count("/") + 2)]
        assert got == {n for n in names if not any(fnmatch.fnmatchcase(p, pattern) for p in parts(n))}, pattern


def _versions(spark, old, new):
    rows = [(False, *r) for r in old] + [(True, *r) for r in new]
    return spark.createDataFrame(rows, "new boolean, " + SCHEMA)


def _random_tree(tree, seed):
    """Entries of one version: files, links, directories named whether they hold something or not; some are files here and folders there."""
    rng, out = random.Random(seed), {}
    for _ in range(rng.randrange(9)):
        path = "/".join(rng.choice("abx") for _ in range(rng.randrange(1, 5)))
        above = ["/".join(path.split("/")[:i]) for i in range(1, path.count("/") + 1)]
        kind = rng.choice(["file", "file", "symlink", "directory", "directory"])
        if any(out.get(p, "directory") != "directory" for p in above) or (kind != "directory" and any(p.startswith(path + "/") for p in out)):
            continue
        out[path] = kind
    return [(tree, p, k, *{"file": (rng.randrange(2), "h", None), "symlink": (None, None, rng.choice("st")), "directory": (None, None, None)}[k]) for p, k in out.items()]


@pytest.mark.parametrize("exclude", [(), ("*/x", "b")])
def test_versions_met_entry_by_entry_differ_as_their_digests_do(spark, exclude):
    old = [r for t in range(150) for r in _random_tree(f"t{t}", 2 * t)]
    new = [r for t in range(150) for r in _random_tree(f"t{t}", 2 * t + t % 5 % 4)]
    trees = [merkle.tree_digests(spark.createDataFrame(rows, SCHEMA), exclude) for rows in (old, new)]
    want = sorted(map(tuple, merkle.changed_paths(*trees).collect()))
    assert {c for *_, c in want} == {"added", "removed", "changed"}
    got = merkle.changed_entries(_versions(spark, old + old[:40], new + new[:40]), exclude)
    assert sorted(map(tuple, got.collect())) == want


def test_versions_differ_by_empty_folders_and_kinds(spark):
    def changed(old, new):
        return {(r.path, r.change) for r in merkle.changed_entries(_versions(spark, [("t", *r) for r in old], [("t", *r) for r in new])).collect()}

    folder, file = lambda p: (p, "directory", None, None, None), lambda p, h="h": (p, "file", 1, h, None)
    top = {("a", "changed"), ("", "changed")}
    assert changed([file("a/c"), folder("a/b/e")], [file("a/c")]) == top | {("a/b/e", "removed"), ("a/b", "removed")}
    assert changed([file("a/c")], [file("a/c"), folder("a/b")]) == top | {("a/b", "added")}
    assert changed([folder("a"), file("a/c")], [file("a/c")]) == set()
    assert changed([folder("a")], [file("a/c")]) == top | {("a/c", "added")}
    assert changed([file("a")], [file("a/c")]) == top | {("a/c", "added")}
    assert changed([file("a")], [folder("a")]) == top
    assert changed([], [folder("")]) == {("", "added")}
    assert changed([], []) == set()
    for kind in ("socket", None):
        with pytest.raises(Exception, match="special file system entry"):
            changed([], [("p", kind, None, None, None)])


def test_versions_meet_where_files_have_met_their_jobs(spark):
    """Entries are shuffled once, with their jobs; then only folders' flags and what has changed."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = queries.queries()["changed_folders"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    dealt = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert sum(d.startswith(("job_id", "o_orderkey", "l_orderkey")) for d in dealt) == 2  # files and jobs
    assert sum(d.startswith("tree") for d in dealt) == 2  # flags, and what has changed
