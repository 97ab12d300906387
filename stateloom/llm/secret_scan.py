"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by three patterns.  The hash of every candidate's value is aggregated
over the corpus by distinct repositories and owners: a value that many owners hold is a
widely copied example, one that a single owner holds and that looks random is a
live-looking credential, and its place is added to the document's spans as kind ``live``.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


class Kind(NamedTuple):
    name: str
    pattern: str
    group: int  # the group that holds the value; it ends the match
    least: int  # characters of that group
    mark: str | None = None  # finds the same matches of ``least`` characters or more, and no shorter ones


KINDS: tuple[Kind, ...] = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # Runs are maximal, so a least length inside the pattern drops the short ones and moves no other.
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Kind("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
)
#: Private-use characters: the mark around matches, and what stands for it if a text holds it.
_MARK, _INSTEAD = "", ""


#: Parts of a marked text that are placed together; the time for n parts is n * PLACED + (n / PLACED)**2.
PLACED = 128


def _pieces(marked: Column) -> Column:
    """The parts of a text between marks; text and matches alternate."""
    return F.split(marked, _MARK, -1)


def _runs(parts: Column) -> Column:
    """The parts in runs of PLACED."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / PLACED).cast("int")), lambda i: F.slice(parts, i * PLACED + 1, PLACED))


def _begins(runs: Column) -> Column:
    """Where each run begins, in code points."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    length = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, part: n + F.length(part))

    def step(state: Column, n: Column) -> Column:
        return F.struct((state["at"] + n).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))

    return F.aggregate(F.transform(runs, length), zero, step)["out"]


def _matches(runs: Column, begins: Column, number: int, kind: Kind) -> Column:
    """Array of (start, kind, end, value_start, hash, random) from runs of parts and their begins.

    Every second part is a match; lengths up to it give its place.  Runs have an even
    number of parts, so each begins with text.
    """
    found = "array<struct<start:long,end:long,text:string>>"

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        match = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("text"))
        out = F.when(state["inside"], F.array_append(state["out"], match)).otherwise(state["out"])
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), out.alias("out"))

    def place(run: Column) -> Column:
        zero = F.struct(run["begins"].alias("at"), F.lit(False).alias("inside"), F.array().cast(found).alias("out"))
        return F.aggregate(run["runs"], zero, step)["out"]

    placed = F.flatten(F.transform(F.arrays_zip(runs.alias("runs"), begins.alias("begins")), place))
    value = (lambda x: F.regexp_extract(x["text"], kind.pattern, kind.group)) if kind.group else (lambda x: x["text"])
    valued = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value")))
    return F.transform(
        F.filter(valued, lambda x: F.length(x["value"]) >= kind.least),
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("kind"),
            x["end"].alias("end"),
            (x["end"] - F.length(x["value"])).alias("value_start"),
            F.sha2(x["value"], 256).alias("hash"),
            _looks_random(x["value"]).alias("random"),
        ),
    )


def _looks_random(value: Column) -> Column:
    """A digit, a letter, and at least 8 distinct characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """id, text_hash, owner, repository and found: the candidates of each text, by start and kind."""
    none = F.array().cast("array<struct<start:long,kind:int,end:long,value_start:long,hash:string,random:boolean>>")
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        owner.alias("owner"),
        repository.alias("repository"),
        F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, _INSTEAD).alias("text"),
    )
    marked = [F.regexp_replace("text", k.mark or k.pattern, f"{_MARK}$0{_MARK}").alias(f"m{i}") for i, k in enumerate(kinds)]
    # A kind's matches; a text without the mark has none.  Each step's columns are used twice
    # by the next, so that they are computed once.
    names = ["id", "text_hash", "owner", "repository"]
    held = texts.select(*names, *marked)
    held = held.select(*names, *[F.when(F.instr(f"m{i}", _MARK) > 0, _pieces(F.col(f"m{i}"))).alias(f"p{i}") for i in range(len(kinds))])
    held = held.select(*names, *[F.when(F.size(f"p{i}") > 0, _runs(F.col(f"p{i}"))).alias(f"r{i}") for i in range(len(kinds))])
    held = held.select(*names, *[f"r{i}" for i in range(len(kinds))], *[_begins(F.col(f"r{i}")).alias(f"b{i}") for i in range(len(kinds))])
    found = [F.coalesce(_matches(F.col(f"r{i}"), F.col(f"b{i}"), i, k), none) for i, k in enumerate(kinds)]
    return held.select(*names, F.array_sort(F.concat(*found)).alias("found"))


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = 3,
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, counts by kind, base_sha256, spans, n_live, n_examples.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; a
    ``live`` span is the value of a candidate that one owner in one repository holds and
    that looks random.  n_examples counts candidates held by ``example_owners`` owners or
    more.  A null or empty text has none.  A null owner or repository is one of its own.
    Rows that repeat an id are told apart by their text's hash; null ids are told apart the
    same way.  Only id, text, owner and repository are read, so other names cannot clash.

    The patterns run once: what they find, hashes instead of values, is written to the
    shared folder.  Owners are counted from distinct (hash, owner, repository), which
    are pre-aggregated, and spans of a hot hash are joined in parts.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    owner = owner if owner is not None else F.col("source")
    repository = repository if repository is not None else F.concat_ws("/", F.col("source"), F.col("lang"))
    named = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (owner, repository)]
    scanned = scratch.keep(candidates(docs, id_col, text_col, *named))

    spread = scanned.select("id", "text_hash", "owner", "repository", F.explode("found").alias("x"))
    holders = spread.select("x.hash", "owner", "repository").distinct()
    owned = holders.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    # Rows equal in id and text have equal spans, so one of them stands for all.
    values = spread.select("id", "text_hash", "x.hash", "x.random", "x.value_start", "x.end", "x.kind").distinct()
    judged = values.join(owned, "hash").select(
        "id",
        "text_hash",
        F.when(F.col("random") & (F.col("owners") == 1) & (F.col("repositories") == 1), F.struct(F.col("value_start").alias("start"), F.lit(len(KINDS)).alias("kind"), "end")).alias("live"),
        (F.col("owners") >= example_owners).alias("example"),
    )
    by_text = judged.groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.collect_set("live").alias("live"), F.count_if("example").alias("n_examples")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    joined = scanned.join(by_text, same, "left")

    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit("live"))
    written = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    base = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    live = F.coalesce(F.col("live"), F.array().cast("array<struct<start:long,kind:int,end:long>>"))
    counts = [F.size(F.filter("found", _of_kind(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return joined.select(
        F.col("id").alias(id_col),
        *counts,
        F.sha2(F.array_join(F.transform(base, written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(F.concat(base, live)), written), ",").alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )


def _of_kind(i: int):
    return lambda x: x["kind"] == i
