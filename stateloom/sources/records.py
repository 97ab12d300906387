"""Readers of recorded state: markers from paths, JSON documents, logs; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import UUID, parse_job_key, parse_marker_basename
from ..schemas import STATE_KINDS


def markers_from_paths(paths: DataFrame, path_col: str = "path", root: str = "") -> DataFrame:
    """Markers parsed from relative paths kind/placement.../basename; malformed rows keep a fault.

    A row is never dropped: ``fault`` says why it is not a marker.
    """
    path = F.regexp_replace(path_col, f"^{root}/?", "") if root else F.col(path_col)
    parts = F.split(path, "/")
    kind, name = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    placement = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    parsed = parse_marker_basename(name)
    fault = (
        F.when(~kind.isin(*STATE_KINDS), "unknown kind")
        .when(F.size(parts) < 3, "no placement")
        .when(parsed["job_id"].isNull(), "malformed name")
        .when(~parsed["job_id"].rlike(f"^{UUID}$"), "job id is not a UUID")
    )
    return paths.select(
        "*", kind.alias("kind"), placement.alias("placement"), parsed.alias("_m"), fault.alias("fault")
    ).select(*paths.columns, "kind", "placement", "_m.tag", "_m.job_id", "_m.priority", "_m.generation", "_m.record_ref", "fault")


def scan_markers(markers: DataFrame) -> DataFrame:
    return markers.where("fault IS NULL")


def read_documents(spark: SparkSession, path: str, pattern: str = "job.json") -> DataFrame:
    """Definitions with the digest of their stored bytes; malformed JSON, or bytes that are no UTF-8, are a null document."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.sha2("content", 256).alias("digest"), F.try_parse_json(text).alias("document"), F.col("length"))


def last_headline(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """The message of the last JSON line of kind headline; bad lines are skipped.  lines: key, line_no, line."""
    document = F.try_parse_json("line")
    rows = lines.select(key, "line_no", F.try_variant_get(document, "$.kind", "string").alias("k"), F.try_variant_get(document, "$.message", "string").alias("m"))
    return rows.where("k = 'headline'").groupBy(key).agg(F.max_by("m", "line_no").alias("headline"))


def last_assignments(lines: DataFrame, key: str = "job_id") -> DataFrame:
    """The last value of each ``NAME = VALUE``; comments after # or ! and lower case names count."""
    clean = F.regexp_replace("line", "[#!].*$", "")
    name = F.upper(F.regexp_extract(clean, r"^\s*([A-Za-z][A-Za-z0-9_]*)\s*=", 1))
    value = F.trim(F.regexp_extract(clean, r"=\s*(.*)$", 1))
    return lines.select(key, "line_no", name.alias("name"), value.alias("value")).where("name <> ''").groupBy(key, "name").agg(F.max_by("value", "line_no").alias("value"))


def newest_runs(runs: DataFrame, task: str, date: str, name: str) -> DataFrame:
    """The newest dated run of each task by (date, name)."""
    return runs.groupBy(task).agg(F.max_by(F.struct(*[c for c in runs.columns if c != task]), F.struct(date, name)).alias("r")).select(task, "r.*")


def write_rows(rows: DataFrame, path: str, bad: Column | None = None, rejects: str | None = None) -> None:
    """JSON lines of the good rows; bad rows go to the rejects table, never dropped."""
    if bad is not None and rejects:
        rows.where(bad).write.mode("append").json(rejects)
        rows = rows.where(~F.coalesce(bad, F.lit(False)))
    rows.write.mode("append").json(path)


def merge_current(current: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """Compare-and-swap upsert: an update applies if its version follows the current one.

    New keys start at 1.  Of several updates to a key that fit, the least one by its other
    columns in their order wins, so every run picks the same.
    """
    base = current.select(key, F.col(version).alias("_have"))
    fits = updates.join(base, key, "left").where(F.col(version) == F.coalesce("_have", F.lit(0)) + 1).drop("_have")
    won = fits.groupBy(key).agg(F.min(F.struct(*[c for c in updates.columns if c != key])).alias("_won")).select(key, "_won.*").select(*updates.columns)
    return current.join(won.select(key), key, "left_anti").unionByName(won)


def read_breadcrumbs(spark: SparkSession, root: str, attempt: str = r"/([^/]*)/error\.json$") -> DataFrame:
    """(path, attempt, document) of the error.json that attempts left; one that is no JSON is null."""
    found = read_documents(spark, root, "error.json")
    return found.select("path", F.regexp_extract("path", attempt, 1).alias("attempt"), "document")


def read_ledgers(spark: SparkSession, control: str) -> DataFrame:
    """The transfer ledgers of a workspace: path, document, and what an offer says of each, in the order of their names."""
    found = read_documents(spark, f"{control}/transfers", "*.json")
    member = lambda name, path=None: F.try_variant_get("document", f"$.{path or name}", "string").alias(name)
    offer = [member("transfer_id"), member("job_id"), member("job_key"), member("state", "prior_kind"), member("placement", "destination_placement"), member("source_placement"), member("payload_sha256")]
    return found.select("path", "document", *offer).orderBy("path")


def read_settings(spark: SparkSession, control: str) -> DataFrame:
    """(name, value) of a workspace's settings, values as JSON; without settings none."""
    found = read_documents(spark, control, "format.json").select(F.from_json(F.to_json(F.try_variant_get("document", "$.settings", "variant")), "map<string,variant>").alias("s"))
    return found.select(F.explode("s").alias("name", "v")).select("name", F.to_json("v").alias("value"))


# Names of structure files.
STRUCTURE_NAMES = ("POSCAR", r"POSCAR\..*", r".*\.vasp")


def structure_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Files whose names are those of structures, with ``position``: by pattern, then by path."""
    name = F.element_at(F.split(path, "/"), -1)
    rank = F.coalesce(*[F.when(name.rlike(f"(?s)^(?:{p})$"), i) for i, p in enumerate(STRUCTURE_NAMES)])
    return files.withColumn("pattern", rank).where("pattern IS NOT NULL")


def runlog_events(events: DataFrame, files: DataFrame, format: str = "runlog-event", version: int = 2) -> DataFrame:
    """(job_id, position, line): run-log events as JSON lines, each with the digests and contents of its files.

    ``events``: job_id, position, timestamp, kind, message; ``files``: job_id, position, path,
    content (binary).  An event without a kind, or with a NUL in it, is an error.
    """
    one = F.struct("path", F.sha2("content", 256).alias("sha256"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    held = files.groupBy("job_id", "position").agg(F.array_sort(F.collect_list(one)).alias("files"))
    kind = F.when((F.coalesce("kind", F.lit("")) == "") | F.col("kind").contains("\0"), F.raise_error(F.lit("a run-log kind is a text without NUL"))).otherwise(F.col("kind"))
    none = F.array().cast("array<struct<path:string,sha256:string,content:string>>")
    # Members in the order of their names, as canonical JSON has them.
    files_sorted = F.transform(F.coalesce("files", none), lambda x: F.struct(x["content"].alias("content"), x["path"].alias("path"), x["sha256"].alias("sha256")))
    line = F.struct(files_sorted.alias("files"), F.lit(format).alias("format"), F.lit(version).alias("format_version"), kind.alias("kind"), "message", "timestamp")
    return events.join(held, ["job_id", "position"], "left").select("job_id", "position", F.to_json(line).alias("line"))
