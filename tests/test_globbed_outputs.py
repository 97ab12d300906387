"""Output files by their patterns: odd names, several patterns a port, and no row for a file and a pattern."""

from fnmatch import fnmatchcase

from pyspark.sql import functions as F

from stateloom.operators import upkeep

DECLARED = [
    ("a", 1, "x*", "file", False), ("a", 0, "y?", "file", False), ("b", 0, "*", "array", True), ("b", 0, "x1", "array", True), ("c", 0, "n.[1]+", "file", True),
    ("d", 0, "d/?", "array", False), ("e", 0, None, "file", False), (None, 0, "z", "file", False), ("f", 0, "x1", "file", None),
]
FILES = {1: ["x2", "x1", "ya", "n.[1]+", "nx[1]+", "d/1", "d/22", "x1", None], 2: ["yab", "d/1/2"], 3: [], None: ["x1"]}
FIELDS = ("port", "ordinal", "pattern", "kind", "optional")
OUTPUTS = "array<struct<port: string, ordinal: int, pattern: string, kind: string, optional: boolean>>"


def by_hand(paths, port, kind, optional):
    met = lambda p, g: p is not None and g is not None and p.count("/") == g.count("/") and all(fnmatchcase(a, b.replace("[", "[[]")) for a, b in zip(p.split("/"), g.split("/")))
    found = [p for _, p in sorted((o, p) for n, o, g, k, q in DECLARED if (n, k, q) == (port, kind, optional) for p in paths if met(p, g))]
    return (found if kind == "array" else found[:1]), "matched nothing" if kind != "array" and not found and optional is False else None


def test_globbed_outputs_equal_plain_matching(spark):
    files = spark.createDataFrame([(r, p) for r, ps in FILES.items() for p in ps] + [(9, "x1")], "run_id long, path string")
    runs = spark.createDataFrame([(r, DECLARED) for r in FILES] + [(8, [])], f"run_id long, outputs {OUTPUTS}")
    got = {(r.run_id, r.port, r.fault is not None): list(r.paths) for r in upkeep.globbed_outputs(runs, files, F.col("outputs")).collect()}
    want = {}
    for run, paths in FILES.items():
        for port, kind, optional in {(n, k, q) for n, _, _, k, q in DECLARED}:
            found, fault = by_hand(paths if run is not None else [], port, kind, optional)
            want[run, port, fault is not None] = found
    assert got == want


def test_files_and_rules_make_no_rows(spark):
    """Nothing is aggregated, sorted or shuffled after files and rules have met."""
    files = spark.range(1000).selectExpr("id % 100 AS run_id", "concat('x', id) AS path")
    made = upkeep.globbed_outputs(files.select("run_id").distinct(), files, F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(FIELDS, d)]) for d in DECLARED[:4]]))
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan[: plan.index("Join")]
    assert "Generate" in above and not any(x in above for x in ("Aggregate", "Sort", "Exchange"))
    assert made.count() == 200
