"""Diagnosis of log text: a pattern catalogue, last matches, classification, remedies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Messages of a simulation program, their codes, severities and whether they stop a run.
PATTERNS: tuple[tuple[str, str, str, bool], ...] = (
    (r"chargedensity file is incomplete", "chgcar_incomplete", "error", True),
    (r"ZPOTRF failed", "zpotrf", "fatal", True),
    (r"FEXCF: supplied exchange-correlation table", "fexcf", "error", True),
    (r"Reciprocal lattice and k-lattice belong to different class", "kpoints_class", "error", True),
    (r"Tetrahedron method fails|Fatal error.*k-mesh|unable to match k-point|TETIRR needs", "tetrahedron_kpoints", "error", True),
    (r"inverse of rotation matrix was not found", "inverse_rotation", "error", True),
    (r"Found some non-integer element in rotation matrix", "rotation_matrix", "error", True),
    (r"BRMIX: very serious problems", "brmix", "warning", False),
    (r"Could not get correct shifts", "kpoint_shifts", "warning", False),
    (r"REAL_OPTLAY: internal error", "real_optlay", "error", True),
    (r"(?:internal ERROR RSPHER|RSPHER: internal ERROR)", "rspher", "fatal", True),
    (r"DENTET: can't reach specified precision", "dentet", "warning", False),
    (r"TOO FEW BANDS", "too_few_bands", "error", False),
    (r"triple product of the basis vectors", "triple_product", "fatal", True),
    (r"BRIONS problems: POTIM should be increased", "brions", "warning", False),
    (r"small aliasing.*errors", "aliasing", "warning", False),
    (r"distance between some ions is very small", "ions_too_close", "fatal", True),
    (r"set LREAL=.FALSE", "lreal_false", "error", True),
    (r"number of cells and number of vectors did not agree", "pricell", "error", True),
    (r"internal error in RAD_INT", "radint", "fatal", True),
    (r"internal ERROR in NONLR_ALLOC", "nonlr_alloc", "fatal", True),
    (r"Error EDDDAV: Call to ZHEGV failed", "edddav_zhegv", "error", False),
    (r"CNORMN: search vector ill defined", "cnormn", "warning", False),
    (r"ZBRENT: fatal error in bracketing", "zbrent_bracketing", "error", False),
    (r"One of the lattice vectors is very long", "lattice_vector_too_long", "fatal", True),
)
# The order in which problems are remedied, and the number of steps of each ladder.
REMEDY_PRECEDENCE = (
    "pricell", "zpotrf", "tetrahedron_kpoints", "zbrent_bracketing", "real_optlay", "ions_too_close",
    "nonlr_alloc", "kpoints_class", "dentet", "kpoint_shifts", "lreal_false", "inverse_rotation",
    "rotation_matrix", "fexcf", "electronic_nonconvergence", "ionic_nonconvergence", "too_few_bands",
)
LADDER_STEPS = {
    "kpoints_class": 6, "dentet": 4, "kpoint_shifts": 1, "lreal_false": 1, "inverse_rotation": 1,
    "rotation_matrix": 1, "fexcf": 4, "electronic_nonconvergence": 5, "pricell": 3,
    "tetrahedron_kpoints": 1, "zbrent_bracketing": 2, "real_optlay": 1, "too_few_bands": 1,
    "ionic_nonconvergence": 1, "zpotrf": 5, "ions_too_close": 1,
}
REMEDY_REFUSALS = ("nonlr_alloc",)


def diagnose_lines(lines: DataFrame, patterns=PATTERNS) -> DataFrame:
    """One row per line and pattern that matches: the line's columns, code, severity, stop.

    The catalogue is a literal array tested in one pass, so no join and no shuffle.
    """
    tests = [F.when(F.col("line").rlike(f"(?i){p}"), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(stop).alias("stop"))) for p, c, s, stop in patterns]
    return lines.withColumn("_d", F.explode(F.array_compact(F.array(*tests)))).select(*lines.columns, "_d.*")


def text_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 0, line)."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The last match in the text, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def run_classification(timed_out: Column, stopped: Column, exit_code: Column, codes: Column) -> Column:
    """timeout, diagnosed_stop, process_failure, nonconverged or completed; the first that holds."""
    nonconverged = F.arrays_overlap(codes, F.array(*map(F.lit, ("electronic_nonconvergence", "ionic_nonconvergence", "positive_final_energy"))))
    return (
        F.when(timed_out, "timeout")
        .when(stopped, "diagnosed_stop")
        .when(exit_code != 0, "process_failure")
        .when(nonconverged, "nonconverged")
        .when(F.array_contains(codes, "incomplete_outcar"), "process_failure")
        .otherwise("completed")
    )


def plan_remedies(spark: SparkSession, found: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Per run the problem first in precedence, its next ladder step, and whether to give up.

    ``found``: key, code.  ``attempts``: key, problem, step.  A refused or unknown problem,
    and a ladder used up, give up.
    """
    order = spark.createDataFrame([(c, i, LADDER_STEPS.get(c, 0), c in REMEDY_REFUSALS) for i, c in enumerate(REMEDY_PRECEDENCE)], "code string, ordinal int, steps int, refused boolean")
    known = found.join(order, "code", "left").groupBy(key).agg(F.min_by(F.struct("code", "steps", "refused"), "ordinal").alias("p"))
    problem = F.coalesce("p.code", F.lit("unknown"))
    tried = attempts.select(key, F.col("problem").alias("_problem"), "step")
    at = known.withColumn("problem", problem).join(tried, key, "left")
    step = F.coalesce(F.max(F.when(F.col("_problem") == F.col("problem"), F.col("step"))), F.lit(0)).cast("long")
    planned = at.groupBy(key, "problem", "p.steps", "p.refused").agg(step.alias("step"))
    give_up = F.coalesce(F.col("refused"), F.lit(True)) | (F.col("step") >= F.coalesce("steps", F.lit(0)))
    return planned.select(key, "problem", "step", give_up.alias("give_up"))


# How the largest blocks of an output file begin, and the line that stands for one.
BLOCK_STARTS = (
    r"^\s*(k-points in units of 2pi/SCALE and weight:|Following reciprocal coordinates:"
    r"|Following cartesian coordinates:|k-points in reciprocal lattice and weights|k-point\s+\d+\s+.*plane waves)"
)
BLOCK_REPLACEMENT = "VASP_CLEAN_OUTCAR: removed k-point detail block"


def without_blocks(lines: DataFrame, key: str, start: str = BLOCK_STARTS, replacement: str = BLOCK_REPLACEMENT) -> DataFrame:
    """Lines without blocks, which run from a line matching ``start`` to the next blank line, inclusive.

    Each starting line becomes the replacement, one inside another block too; blank lines
    outside blocks stay.
    """
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    starts, blank = F.col("line").rlike(start), F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) == ""
    opened = F.max(F.when(starts, F.col("line_no"))).over(before)
    closed = F.max(F.when(blank & ~starts, F.col("line_no"))).over(before)
    inside = opened.isNotNull() & (closed.isNull() | (opened > closed))
    marked = lines.withColumn("_inside", inside).where(starts | ~F.col("_inside"))
    return marked.withColumn("line", F.when(starts, F.lit(replacement)).otherwise(F.col("line"))).drop("_inside")
