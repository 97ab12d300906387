"""Texts of crystal structures and of the programs that relax them, as column functions of whole files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType


def _lines(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


@pandas_udf(StringType())
def number_text(value: pd.Series) -> pd.Series:
    """A double in up to 16 significant digits without trailing zeros, with an exponent below 1e-4 and from 1e16 on.

    Rounded from the exact binary value, which no built-in function does: they round the
    shortest decimal form, so a 17th digit of 5 can go the wrong way.
    """
    return value.map(lambda x: f"{x:.16g}", na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def number_texts(values: pd.Series) -> pd.Series:
    """``number_text`` of the doubles of an array, in one call."""
    return values.map(lambda xs: [None if x is None or x != x else f"{x:.16g}" for x in xs], na_action="ignore")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def header(text: Column) -> Column:
    """struct(comment, scale, lattice, species, counts, fault) of a structure file's first seven lines.

    fault says what is wrong, and is null in a well-formed header: fewer than seven lines, a
    scale, lattice or count that is no number, or species and counts that do not match.
    """
    lines = _lines(text)
    line = lambda i: F.get(lines, F.lit(i))
    scale = F.get(_words(line(1)), F.lit(0)).try_cast("double")
    rows = [F.transform(_words(line(i)), lambda w: w.try_cast("double")) for i in (2, 3, 4)]
    counts = F.transform(_words(line(6)), lambda w: w.try_cast("int"))
    species = _words(line(5))
    numbers = scale.isNotNull() & F.forall(counts, lambda c: c.isNotNull())
    for row in rows:
        numbers = numbers & (F.size(row) == 3) & F.forall(row, lambda x: x.isNotNull())
    matched = (F.size(species) > 0) & (F.size(species) == F.size(counts)) & F.forall(counts, lambda c: c >= 0)
    # A closing newline does not make a line.
    few = F.size(lines) - (F.element_at(lines, -1) == "").cast("int") < 7
    fault = (
        F.when(text.isNull() | few, "fewer than seven header lines")
        .when(~F.coalesce(numbers, F.lit(False)), "invalid scale, lattice or count line")
        .when(~F.coalesce(matched, F.lit(False)), "species and counts do not match")
    )
    return F.struct(line(0).alias("comment"), scale.alias("scale"), F.array(*rows).alias("lattice"), species.alias("species"), counts.alias("counts"), fault.alias("fault"))


def moments(head: Column) -> Column:
    """The comment's own [MAGMOM=...], else five for every atom."""
    own = F.regexp_extract(head["comment"], r"\[MAGMOM=([^\]]+)\]", 1)
    each = F.array_join(F.transform(head["counts"], lambda n: F.concat(n.cast("string"), F.lit("*5"))), " ")
    return F.coalesce(F.nullif(own, F.lit("")), each)


def _with_line(text: Column, place: int, line: Column) -> Column:
    lines = _lines(text)
    return F.array_join(F.concat(F.slice(lines, 1, place), F.array(line), F.slice(lines, place + 2, 1 << 30)), "\n")


def scaled_lattice(text: Column, factor: float) -> Column:
    """The text with its scale line multiplied by a positive factor; null without a scale."""
    if not 0 < factor < float("inf"):
        raise ValueError("a scale factor is positive and finite")
    scale = F.get(_words(F.get(_lines(text), F.lit(1))), F.lit(0)).try_cast("double")
    return F.when(scale.isNotNull(), _with_line(text, 1, number_text(scale * factor)))


def right_handed(text: Column) -> Column:
    """The text with its lattice negated where it is left-handed; null for a malformed header."""
    # A header is read once for the numbers and once for the verdict, and all numbers become texts in one call.
    negated = number_texts(_bound(header(text), lambda h: F.transform(F.flatten(h["lattice"]), lambda x: -x)))

    def left_handed(h: Column) -> Column:
        a, b, c = ([h["lattice"][i][k] for k in range(3)] for i in range(3))
        volume = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        return F.when(h["fault"].isNull(), F.coalesce(volume < 0, F.lit(False)))

    lines, left = _lines(text), _bound(header(text), left_handed)
    rows = F.array(*[F.array_join(F.slice(negated, i, 3), " ") for i in (1, 4, 7)])
    flipped = F.array_join(F.concat(F.slice(lines, 1, 2), rows, F.slice(lines, 6, 1 << 30)), "\n")
    return F.get(F.array(text, flipped), left.cast("int"))


def with_comment_of(text: Column, reference: Column) -> Column:
    """The text with its first line taken from a reference; null if either is empty."""
    empty = (F.coalesce(text, F.lit("")) == "") | (F.coalesce(reference, F.lit("")) == "")
    return F.when(~empty, _with_line(text, 0, F.get(_lines(reference), F.lit(0))))


def plane_waves(text: Column) -> Column:
    """The first count of plane waves in an output, or null."""
    return F.regexp_extract(text, r"(?m)^\s*maximum number of plane-waves\s*:\s*([0-9]+)", 1).try_cast("long")


def program_of(text: Column) -> Column:
    """struct(name, version) from the second and third line of a program, both comments; else unknown, 0."""
    lines = _lines(text)
    line = lambda i: F.get(lines, F.lit(i))
    name, version = (F.trim(F.substring(line(i), 2, 1 << 20)) for i in (1, 2))
    good = line(1).startswith("#") & line(2).startswith("#") & (name != "") & (version != "")
    known = F.coalesce(good, F.lit(False))
    return F.struct(F.when(known, name).otherwise("unknown").alias("name"), F.when(known, version).otherwise("0").alias("version"))


def final_diagnostics(files: DataFrame, key: str) -> DataFrame:
    """(key, codes): what a run's output and its step log say of completion and convergence, in fixed order.

    ``files``: key, output, steps (texts, null if absent).  A run without the closing footer
    is incomplete; with a step log, the last electronic step at the limit NELM, as many
    ionic steps as NSW (above 1), and a positive last energy are reported.
    """
    limit = lambda name: F.regexp_extract("output", rf"(?m)^\s*{name}\s*=\s*([0-9]+)", 1).try_cast("long")
    last = lambda pattern: F.try_element_at(F.regexp_extract_all("steps", F.lit(pattern), F.lit(1)), F.lit(-1))
    ionic = r"(?m)^\s*[0-9]+\s+F=\s*([-+0-9.Ee]+)"
    electronic = F.coalesce(last(r"(?m)^[A-Za-z]+:\s+([0-9]+)\s+").try_cast("long"), F.lit(0))
    there = F.col("steps").isNotNull()
    footer = F.coalesce(F.col("output").rlike(r"(?i)General timing and accounting information(?:s)? for this job:"), F.lit(False))
    codes = F.array(
        F.when(~footer, "incomplete_outcar"),
        F.when(there & (electronic >= limit("NELM")), "electronic_nonconvergence"),
        F.when(there & (limit("NSW") > 1) & (F.regexp_count("steps", F.lit(ionic)) >= limit("NSW")), "ionic_nonconvergence"),
        F.when(there & (last(ionic).try_cast("double") > 0), "positive_final_energy"),
    )
    return files.select(key, F.array_compact(codes).alias("codes"))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with ``$name`` and ``${name}`` replaced, ``$$`` as a dollar; a name without a value is an error.

    Names are replaced in one pass, so a value that holds a dollar is left alone.
    """
    parts = F.split(F.regexp_replace(template, r"\$(\$|[A-Za-z_][A-Za-z0-9_]*|\{[A-Za-z_][A-Za-z0-9_]*\})", "\u0001$1\u0001"), "\u0001", -1)
    known = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]) if values else F.create_map().cast("map<string,string>")

    def put(part: Column, i: Column) -> Column:
        name = F.regexp_replace(part, r"[{}]", "")
        missing = F.raise_error(F.concat(F.lit("no value for template name "), name))
        value = F.when(part == "$", F.lit("$")).when(F.map_contains_key(known, name), F.try_element_at(known, name)).otherwise(missing)
        return F.when(i % 2 == 1, value).otherwise(part)

    return F.array_join(F.transform(parts, put), "")
