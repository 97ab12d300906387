"""Digests of folder trees, folded folder by folder from the leaves.

A folder's digest covers the names, kinds and digests of what it holds, so equal trees have
equal digests wherever they lie, and two versions differ exactly along the paths to what
changed.  A folder's entries are first folded in buckets by hash of the name, then bucket by
bucket, so a folder of very many entries is no single group; a level of the tree is one
pair of aggregations, over one shuffle unless a folder of that depth may be very full.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_table

#: Hex digits of the name's digest that make a bucket: 4,096 buckets a folder at most.
BUCKET_DIGITS = 3
#: A folder with more entries below it counts as very full.
FULL = 100_000
#: Levels that are folded in one plan.
LEVELS_A_PLAN = 8


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return out


def glob_rule(pattern: str) -> str:
    """The regular expression of a glob over whole paths; ``*`` and ``?`` match separators too."""
    return f"(?s)^(?:{_glob(pattern)})$"


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def included(path: Column, patterns: Sequence[str]) -> Column:
    """Whether neither a path nor a folder above it is excluded by a glob."""
    if not patterns:
        return F.lit(True)
    return ~path.rlike("(?s)^(?:" + "|".join(map(_glob, patterns)) + r")(?:/|\z)")


def entry_digest(entries: DataFrame) -> Column:
    """The digest of a file by size and content, of a link by its target; of other entries an error."""
    return (
        F.when(F.col("type") == "file", F.sha2(F.concat_ws("|", F.lit("file"), F.col("size").cast("string"), "sha256"), 256))
        .when(F.col("type") == "symlink", F.sha2(F.concat_ws("|", F.lit("symlink"), "target"), 256))
        .otherwise(F.raise_error(F.concat(F.lit("special file system entry: "), F.col("path"))))
    )


def _line() -> Column:
    """What a folder's digest covers of an entry.  Digests travel as 32 bytes and become text here."""
    return F.concat_ws("|", "name", "kind", F.lower(F.hex("digest")))


def _folded(children: DataFrame, full: bool) -> DataFrame:
    """(tree, path, digest, n_files, bytes) of folders, from rows tree, parent, name, kind, digest, n_files, bytes.

    Where a folder may be very full, buckets are dealt out one by one; else a folder's
    entries are dealt out together, once, and both foldings find them in place.
    """
    sums = [F.sum("n_files").alias("n_files"), F.sum("bytes").alias("bytes")]
    placed = children if full else children.repartition("tree", "parent")
    bucket = F.substring(F.sha2("name", 256), 1, BUCKET_DIGITS).alias("bucket")
    buckets = placed.groupBy("tree", "parent", bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(_line())), "\n"), 256).alias("part"), *sums)
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda b: F.concat(b["bucket"], F.lit("|"), b["part"])), "\n"), 256)
    return buckets.groupBy("tree", F.col("parent").alias("path")).agg(F.unhex(whole).alias("digest"), *sums)


def _name() -> Column:
    return F.substring_index("path", "/", -1)


def _parent() -> Column:
    return F.left(F.col("path"), F.length("path") - F.length(_name()) - 1)


def _depth() -> Column:
    return F.when(F.col("path") == "", 0).otherwise(1 + F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))))


def _shape(entries: DataFrame) -> dict[int, tuple[int, int, int]]:
    """By depth: files and links, directories named, and the most entries that one folder of that depth has below it."""
    held = entries.groupBy("tree", _parent().alias("parent"), _depth().alias("depth")).agg(F.count_if(F.col("type") != "directory").alias("leaves"), F.count_if(F.col("type") == "directory").alias("named"))
    above = F.concat(F.array(F.lit("")), F.when(F.col("parent") == "", F.array().cast("array<string>")).otherwise(_prefixes(F.col("parent"))))
    below = held.select("tree", F.posexplode(above).alias("at", "folder"), (F.col("leaves") + F.col("named")).alias("n")).groupBy("tree", "folder", "at").agg(F.sum("n").alias("n"))
    none = F.lit(0).cast("long")
    rows = held.groupBy("depth").agg(F.sum("leaves").alias("leaves"), F.sum("named").alias("named")).select("depth", "leaves", "named", none.alias("most"))
    rows = rows.unionByName(below.groupBy(F.col("at").alias("depth")).agg(F.max("n").alias("most")).select("depth", none.alias("leaves"), none.alias("named"), "most"))
    return {r.depth: (r.leaves, r.named, r.most) for r in rows.groupBy("depth").agg(F.max("leaves").alias("leaves"), F.max("named").alias("named"), F.max("most").alias("most")).collect()}


def tree_digests(entries: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(tree, path, kind, digest, n_files, bytes) of every entry and folder; a tree's own folder has the empty path.

    ``entries``: tree, path, type (file, symlink or directory), size, sha256, target.
    Folders are those above an entry, and the directories named.  An excluded path goes with
    all below it; a folder that only held excluded entries is empty if it is named, else
    it is not there.  Paths are unique in a tree.  Entries are read again for each use rather
    than written; levels are one plan, whose shuffles are shared, and are written only where
    the tree is deeper than ``LEVELS_A_PLAN``.
    """
    kept = entries.where(included(F.col("path"), exclude))
    columns = ["tree", "path", "kind", "digest", "n_files", "bytes"]
    leaves = kept.where("type <> 'directory'").select(
        "tree", "path", F.col("type").alias("kind"), F.unhex(entry_digest(kept)).alias("digest"), F.lit(1).cast("long").alias("n_files"), F.coalesce("size", F.lit(0)).cast("long").alias("bytes")
    )
    none, text = F.lit(0).cast("long"), F.lower(F.hex("digest")).alias("digest")
    hollow = lambda folders: folders.select("tree", "path", F.lit("directory").alias("kind"), F.unhex(F.sha2(F.lit(""), 256)).alias("digest"), none.alias("n_files"), none.alias("bytes"))
    shape = _shape(kept)
    if not shape:
        return leaves.withColumn("digest", text)
    out, block, level, deepest = leaves, [], None, max(shape)
    for d in range(deepest, -1, -1):
        n_leaves, n_named, most = shape.get(d, (0, 0, 0))
        parts, folded = [], None
        if level is not None:
            below = level.select("tree", _parent().alias("parent"), _name().alias("name"), *columns[2:])
            folded = _folded(below, most > FULL).select("tree", "path", F.lit("directory").alias("kind"), *columns[3:])
            parts.append(folded)
        if n_named:
            folders = kept.where("type = 'directory'").where(_depth() == d).select("tree", "path").distinct()
            parts.append(hollow(folders if folded is None else folders.join(folded, ["tree", "path"], "left_anti")))
        made = None
        for part in parts:
            made = part if made is None else made.unionByName(part)
        if made is not None:
            block.append(made)
        if d and (deepest - d) % LEVELS_A_PLAN == LEVELS_A_PLAN - 1 and made is not None:
            whole = block[0].withColumn("_depth", _depth())
            for part in block[1:]:
                whole = whole.unionByName(part.withColumn("_depth", _depth()))
            whole = scratch_table(whole)
            out, block, made = out.unionByName(whole.select(columns)), [], whole.where(F.col("_depth") == d).select(columns)
        level = made
        if n_leaves:
            here = leaves.where(_depth() == d)
            level = here if level is None else level.unionByName(here)
    for part in block:
        out = out.unionByName(part)
    return out.withColumn("digest", text)


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tree, path, change) of what differs between two results of ``tree_digests``: added, removed or changed.

    Folders above a change are changed too; what lies in equal folders is not in the result.
    """
    # Digests are shuffled as 32 bytes, half their text.
    said = lambda rows, name: rows.select("tree", "path", F.struct("kind", F.unhex("digest").alias("digest")).alias(name))
    both = said(old, "o").join(said(new, "n"), ["tree", "path"], "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return both.select("tree", "path", change.alias("change")).where("change IS NOT NULL")


def _above(path: Column) -> Column:
    """The folders above a path, the tree's own first."""
    folders = F.concat(F.array(F.lit("")), F.slice(_prefixes(path), F.lit(1), F.size(F.split(path, "/")) - 1))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(folders)


def changed_entries(entries: DataFrame, exclude: Sequence[str] = (), beside: Sequence[str] = ()) -> DataFrame:
    """(tree, path, change) as ``changed_paths`` has it, of two versions of trees that are at hand as entries.

    ``entries``: those of ``tree_digests`` for both versions, and ``new``, whether a row is of the
    second; a row may repeat.  An entry differs if the other version has none of its digest at its
    path, a folder if something at or below it does; it is added or removed if the other version
    has nothing there.  So no folder needs a digest, and what is shuffled of equal entries are
    flags of their folders.  ``beside``: columns that a path determines in both versions.  Where
    rows lie by these, versions meet without a shuffle.
    """
    kept = entries.where(included(F.col("path"), exclude))
    digest = F.when(F.col("type") == "directory", F.lit(None)).otherwise(F.unhex(entry_digest(kept))).alias("digest")
    met = kept.groupBy(*beside, "tree", "path", digest).agg(F.bool_or(~F.col("new")).alias("before"), F.bool_or("new").alias("after"))
    # A directory that one version names may be there in the other by what it holds; its own row says it is named.
    named, differs = F.col("digest").isNull(), F.col("digest").isNotNull() & (F.col("before") != F.col("after"))
    itself = F.when(named | differs, F.array("path")).otherwise(F.array().cast("array<string>"))
    places = met.select("tree", F.explode(F.concat(_above(F.col("path")), itself)).alias("at"), "before", "after", differs.alias("differs"), (named & (F.col("path") == F.col("at"))).alias("named"))
    flags = places.groupBy("tree", F.col("at").alias("path")).agg(*[F.bool_or(c).alias(c) for c in ("before", "after", "differs", "named")])
    found = flags.where("differs OR before <> after")
    # An empty folder that came or went changes those above it, which both versions have if they are not found themselves.
    change = F.when(~F.col("before"), 1).when(~F.col("after"), 2).otherwise(0).alias("change")
    above = F.when(F.col("named") & (F.col("before") != F.col("after")), F.transform(_above(F.col("path")), lambda p: F.struct(p.alias("path"), F.lit(0).alias("change"))))
    marks = found.select("tree", F.explode(F.concat(F.array(F.struct("path", change)), F.coalesce(above, F.array().cast("array<struct<path:string,change:int>>")))).alias("m"))
    most = marks.groupBy("tree", F.col("m.path").alias("path")).agg(F.max("m.change").alias("change"))
    return most.select("tree", "path", F.when(F.col("change") == 1, "added").when(F.col("change") == 2, "removed").otherwise("changed").alias("change"))
