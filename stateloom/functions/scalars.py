"""Column functions of the recorded formats: keys, references, placements, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def to_base36(value: Column) -> Column:
    """Lower-case base 36 of an unsigned integer; covers the full unsigned 64-bit range."""
    return F.lower(F.conv(value.cast("string"), 10, 36))


def from_base36(text: Column) -> Column:
    """The integer of a lower-case base-36 text up to 2**64 - 1, else null (``conv`` would raise)."""
    fits = text.rlike("^[0-9a-z]{1,12}$") | (text.rlike("^[0-9a-z]{13}$") & (text <= "3w5e11264sgsf"))
    return F.when(fits, F.conv(text, 36, 10).cast("decimal(20,0)"))


def make_job_key(tag: Column, job_id: Column) -> Column:
    """tag--id, or id alone for a null or empty tag."""
    return F.concat_ws("--", F.nullif(tag, F.lit("")), job_id)


def parse_job_key(key: Column) -> Column:
    """struct(tag, job_id): the text before and after the last ``--``; no mark, no tag."""
    tag = F.regexp_extract(key, "^(.*)--", 1)
    return F.struct(F.nullif(tag, F.lit("")).alias("tag"), F.regexp_replace(key, "^.*--", "").alias("job_id"))


def marker_basename(job_key: Column, priority: Column, generation: Column, ref: Column) -> Column:
    """key.pPPP.gGENERATION.reference with a zero-padded priority and a base-36 generation."""
    return F.format_string("%s.p%03d.g%s.%s", job_key, priority.cast("int"), to_base36(generation), ref)


MARKER_NAME = r"^(?:([a-z0-9][a-z0-9._-]{0,47})--)?([^.]+)\.p([0-9]{3})\.g([0-9a-z]+)\.(.+)$"


def parse_marker_basename(name: Column) -> Column:
    """struct(tag, job_id, priority, generation, record_ref); all null for a malformed name."""
    part = lambda i: F.nullif(F.regexp_extract(name, MARKER_NAME, i), F.lit(""))
    return F.struct(
        part(1).alias("tag"),
        part(2).alias("job_id"),
        part(3).try_cast("int").alias("priority"),
        from_base36(part(4)).alias("generation"),
        part(5).alias("record_ref"),
    )


RECORD_REF = "^w([0-9a-f]{32})-s([0-9a-z]+)-o([0-9a-z]+)-l([0-9a-z]+)-h([0-9a-f]{32})$"


def encode_record_ref(writer: Column, segment: Column, offset: Column, length: Column, checksum: Column) -> Column:
    """w<writer>-s<segment>-o<offset>-l<length>-h<first 32 hex digits of the checksum>."""
    numbers = [F.concat(F.lit(mark), to_base36(n)) for mark, n in (("s", segment), ("o", offset), ("l", length))]
    return F.concat_ws("-", F.concat(F.lit("w"), F.replace(writer, F.lit("-"), F.lit(""))), *numbers, F.concat(F.lit("h"), F.substring(checksum, 1, 32)))


def parse_record_ref(ref: Column) -> Column:
    """struct(writer, segment, offset, length, checksum); all null for a malformed text."""
    part = lambda i: F.nullif(F.regexp_extract(ref, RECORD_REF, i), F.lit(""))
    number = lambda i: from_base36(part(i)).cast("long")
    return F.struct(part(1).alias("writer"), number(2).alias("segment"), number(3).alias("offset"), number(4).alias("length"), part(5).alias("checksum"))


def valid_placement(path: Column) -> Column:
    """A relative path of components that are not empty, ``.`` or ``..``, 255 bytes each at most."""
    return F.forall(F.split(path, "/"), lambda c: (F.octet_length(c) > 0) & (F.octet_length(c) <= 255) & ~c.isin(".", ".."))


def under_placement(path: Column, prefix: str) -> Column:
    """Component-wise prefix: ``a/b`` holds ``a/b`` and ``a/b/c``, never ``a/bc``.

    Both tests push down to the scan as equality and starts-with.
    """
    return (path == prefix) | path.startswith(prefix + "/") if prefix else F.lit(True)


def partition_of(key: Column, partitions: int) -> Column:
    """First 8 bytes of SHA-256, big-endian, modulo the number of partitions."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(partitions).cast("decimal(20,0)")).cast("int")


def environment_variable(name: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.upper(F.replace(name, F.lit("."), F.lit("_"))))


def structure_tag(filename: Column) -> Column:
    """A tag from a file name: lower case, no suffix, other characters as ``-``, 48 at most."""
    stem = F.regexp_replace(F.lower(F.regexp_replace(filename, "^.*/", "")), r"\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9._-]+", "-"), "^[^a-z0-9]+", "")
    return F.nullif(F.substring(clean, 1, 48), F.lit(""))


def aware_timestamp(text: Column) -> Column:
    """A timestamp with an offset; a text without one is treated as absent."""
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def backoff_schedule(initial: float, factor: float, most: float, total: float, steps: int) -> Column:
    """Delays that grow by ``factor`` up to ``most`` and stop when their sum reaches ``total``."""
    delays = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.least(F.lit(initial) * F.pow(F.lit(factor), i), F.lit(most)))
    zero = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<double>").alias("out"))

    def step(state: Column, delay: Column) -> Column:
        left = F.greatest(F.lit(total) - state["spent"], F.lit(0.0))
        now = F.least(delay, left)
        kept = F.when(left > 0, F.array_append(state["out"], now)).otherwise(state["out"])
        return F.struct((state["spent"] + now).alias("spent"), kept.alias("out"))

    return F.aggregate(delays, zero, step)["out"]


def tolerant_int(value: Column) -> Column:
    """An integer from a variant: booleans are null, fractions truncate toward zero, numeric text counts."""
    kind = F.schema_of_variant(value)
    number = F.coalesce(F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string").try_cast("double"))
    return F.when(kind == "BOOLEAN", F.lit(None)).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("long")


def value_kind(value: Column) -> Column:
    """The declared kind of a JSON value held as a variant."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)")
    item = F.regexp_extract(kind, "^ARRAY<(.*)>$", 1)
    return (
        F.when(kind == "BOOLEAN", "boolean")
        .when(number, "float")
        .when(kind == "STRING", "string")
        .when(item == "BOOLEAN", "list of boolean")
        .when(item.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "list of float")
        .when(kind.startswith("ARRAY<"), "list of string")
        .when(kind.startswith("OBJECT"), "dict")
    )


def absent_or_null(document: Column, path: str) -> Column:
    """``absent``, ``null`` or ``present`` for a member of a variant document."""
    member = F.variant_get(document, path, "variant")
    return F.when(member.isNull(), "absent").when(F.is_variant_null(member), "null").otherwise("present")


def timestamp_seconds(text: Column) -> Column:
    """Seconds since 1970 of an ISO 8601 text, to the microsecond; without an offset it is session-local; null if malformed."""
    at = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), text.try_cast("timestamp"))
    return F.unix_micros(at) / 1_000_000
