"""Old result trees: finished tasks with what their folders say, and their collection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.structures import program_of
from ..operators.upkeep import finished_tasks, unfinished_tasks
from ..sources.members import decoded

# Members of an old task, and the scheme of an identity made from one.
STEPS, PROGRAM, CONFIG, MANIFEST = "ht_steps", "ht_run", "ht.config", "ht.manifest.bz2"
SCHEME = "v1:"
#: The last lines of a manifest, which its digest does not cover (its signature).
UNSIGNED_LINES = 2


def manifest_digest(content: bytes) -> str | None:
    """The SHA-256 of a packed manifest without its last two lines; of all of it below three lines; None for a damaged one.

    It is decoded in pieces; only the lines that may be the last two are held.
    """
    digest, held, n = hashlib.sha256(), [b""], 0
    try:
        for piece in decoded(content):
            first, *more = piece.split(b"\n")
            held[-1] += first
            for line in more:
                held[-1] += b"\n"
                held.append(line)
                n += 1
                # The last one may still be empty, which is no line.
                while len(held) > UNSIGNED_LINES + 1:
                    digest.update(held.pop(0))
    except (OSError, EOFError, ValueError):
        return None
    lines = n + (held[-1] != b"")
    keep = len(held) if lines < UNSIGNED_LINES + 1 else len(held) - UNSIGNED_LINES - (held[-1] == b"")
    for line in held[:keep]:
        digest.update(line)
    return digest.hexdigest()


@pandas_udf(StringType())
def _manifest_digests(content: pd.Series) -> pd.Series:
    return content.map(manifest_digest, na_action="ignore")


def description_of(config: Column) -> Column:
    """The description in the main section of an ini text, or null."""
    section = F.regexp_extract(F.concat(F.lit("\n"), config), r"\n\[main\][^\n]*((?:\n(?!\[)[^\n]*)*)", 1)
    return F.nullif(F.trim(F.regexp_extract(section, r"(?i)\ndescription[ \t]*[=:][ \t]*([^\n]*)", 1)), F.lit(""))


def described_tasks(tasks: DataFrame, runs: DataFrame, members: DataFrame, root: str) -> DataFrame:
    """Finished tasks with a dated run: taskset, task_id, run, computed_at, code, version, description, identity.

    ``tasks`` and ``runs``: as for ``finished_tasks``; ``members``: path (of the task), name,
    content (binary).  The program is the steps file, or the run file where there is none.
    The identity is made from the manifest, or, unstable, from the place of the run below
    ``root``, where there is no manifest that can be read.
    """
    member = lambda name: F.any_value(F.when(F.col("name") == name, F.col("content")), ignoreNulls=True)
    wanted = members.where(F.col("name").isin(STEPS, PROGRAM, CONFIG, MANIFEST))
    held = wanted.groupBy("path").agg(F.coalesce(member(STEPS), member(PROGRAM)).alias("_program"), member(CONFIG).alias("_config"), member(MANIFEST).alias("_manifest"))
    text = lambda c: F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string"))
    done = finished_tasks(tasks, runs).join(held, "path", "left")
    code = program_of(F.coalesce(text("_program"), F.lit("")))
    place = F.sha2(F.concat_ws("/", F.lit(root.rstrip("/")), "path", "run"), 256)
    told = done.select("*", code["name"].alias("code"), code["version"].alias("version"), description_of(text("_config")).alias("description"), _manifest_digests("_manifest").alias("manifest_hash"))
    return told.select(
        "path", "taskset", "task_id", "run", "computed_at", "code", "version", "description", "manifest_hash",
        F.concat(F.lit(SCHEME), F.coalesce("manifest_hash", place)).alias("immutable_id"),
        F.col("manifest_hash").isNotNull().alias("identity_stable"),
    )


def tree_counts(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """(status, n): unfinished tasks by status, and finished ones without a dated run as ``no_run``."""
    skipped = tasks.where("status = 'finished'").join(finished_tasks(tasks, runs).select("path"), "path", "left_anti")
    lost = skipped.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("no_run").alias("status"), "n")
    return unfinished_tasks(tasks).unionByName(lost)


def collect_finished_tree(described: DataFrame, extract: Callable[[dict], Mapping[str, object]]) -> DataFrame:
    """Each task with the outputs (JSON text) that ``extract`` makes of it, or degraded with its error.

    Results of old trees are uneven: an extractor that raises, or gives no mapping with text
    keys, costs its own task only.
    """
    schema = StructType([*described.schema, StructField("outputs", StringType()), StructField("degraded", StringType())])

    def outcome(task: dict) -> tuple[str | None, str | None]:
        try:
            made = extract(task)
            if not isinstance(made, Mapping) or not all(isinstance(k, str) for k in made):
                raise ValueError("an extractor returns a mapping of output roles")
            return json.dumps(dict(made), sort_keys=True, separators=(",", ":")), None
        except Exception as e:  # noqa: BLE001  an extractor may raise anything; its task degrades
            return None, f"{task['path']}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [outcome(t) for t in batch.to_dict("records")]
            yield batch.assign(outputs=[m[0] for m in made], degraded=[m[1] for m in made])

    return described.mapInPandas(run, schema)
