"""Outputs of collected jobs: by roles from a result document, and those of a relaxation from its texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.structures import header


def document_outputs(documents: DataFrame, roles: DataFrame, prefix: str = "") -> DataFrame:
    """(job_id, port, role, kind, value, path, fault): each port of a result document under its role.

    ``documents``: job_id, outputs (JSON text of an object); ``roles``: job_id, port, role.  A
    value that is an object of class File is a file, with its path below ``prefix``; others
    are data, as JSON.  A port without a role, a document that is no object, and a file
    without a location are faults; no port is left out.
    """
    parsed = documents.select("job_id", F.when(F.col("outputs").rlike(r"^\s*\{"), F.from_json("outputs", "map<string,variant>")).alias("_ports"))
    bad = parsed.where("_ports IS NULL").select("job_id", F.lit("the document is no object").alias("fault"))
    ports = parsed.where("_ports IS NOT NULL").select("job_id", F.explode("_ports").alias("port", "_value")).join(roles, ["job_id", "port"], "left")
    text = F.to_json("_value")
    # Only an object has a class; asked of its text, other values give none.
    is_file = F.coalesce(F.get_json_object(text, "$.class") == "File", F.lit(False))
    place = F.coalesce(F.get_json_object(text, "$.path"), F.regexp_replace(F.get_json_object(text, "$.location"), "^file://", ""))
    below = F.concat_ws("/", F.nullif(F.lit(prefix), F.lit("")), place)
    fault = F.when(F.col("role").isNull(), "no role").when(is_file & place.isNull(), "a file without a location")
    found = ports.select(
        "job_id", "port", "role", F.when(is_file, "file").otherwise("data").alias("kind"), F.when(~is_file, text).alias("value"), F.when(is_file & place.isNotNull(), below).alias("path"), fault.alias("fault")
    )
    return found.unionByName(bad, allowMissingColumns=True)


def final_energy(output: Column) -> Column:
    """The last energy without entropy in a program's output, extrapolated to zero smearing; null without one."""
    rows = F.regexp_extract_all(output, F.lit(r"energy\(sigma->0\)\s*=\s*(\S+)"), 1)
    return F.try_element_at(rows, F.lit(-1)).try_cast("double")


def relaxed_outputs(jobs: DataFrame) -> DataFrame:
    """(job_id, relaxed_structure, total_energy, error) of relaxations; an error leaves both null.

    ``jobs``: job_id, structure (text of the final structure), output (text of the program).
    """
    energy, head = final_energy(F.col("output")), header(F.col("structure"))
    error = (
        F.when(F.col("structure").isNull(), "no final structure")
        .when(head["fault"].isNotNull(), F.concat(F.lit("cannot construct relaxed structure: "), head["fault"]))
        .when(F.col("output").isNull(), "no output")
        .when(energy.isNull() | F.isnan(energy), "cannot construct total energy")
    )
    read = jobs.select("job_id", "structure", energy.alias("_energy"), error.alias("error"))
    good = F.col("error").isNull()
    return read.select("job_id", F.when(good, F.col("structure")).alias("relaxed_structure"), F.when(good, F.col("_energy")).alias("total_energy"), "error")
