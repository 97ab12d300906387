"""Values that flow through a workflow document: references, outputs, node arguments, checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import partition_of

# Fixed value: a plain parameter reference.
REFERENCE = r"\$\((inputs|runtime)\.([A-Za-z_][A-Za-z0-9_.]*)\)"


def value_text(value: Column) -> Column:
    """The command-line text of a variant: a file's path or base name, lower-case booleans, '' for null."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    is_file = F.try_variant_get(value, "$.class", "string").isin("File", "Directory")
    path = F.coalesce(F.nullif(F.try_variant_get(value, "$.path", "string"), F.lit("")), F.try_variant_get(value, "$.basename", "string"), F.lit(""))
    return F.when(value.isNull() | F.is_variant_null(value), "").when(is_file, path).otherwise(text)


def interpolated(rows: DataFrame, key: str, text: str, bindings: DataFrame) -> DataFrame:
    """``rows`` with the references in a text replaced: resolved, and whole where the text is one reference.

    ``bindings``: key, namespace, path (dotted), value (variant).  A text that is exactly one
    reference has its value, of any type, in ``whole``; in other texts a reference becomes
    its value's text, and one without a value nothing.  References are joined to bindings by
    equality, one row each.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    # Every second part of the text, cut at references, is one.
    parts = F.split(F.regexp_replace(text, REFERENCE, "\u0001$1.$2\u0001"), "\u0001", -1)
    cut = numbered.select("_row", key, F.posexplode(parts).alias("_at", "_part"))
    named = cut.withColumn("namespace", F.when(F.col("_at") % 2 == 1, F.substring_index("_part", ".", 1)))
    named = named.withColumn("path", F.when(F.col("_at") % 2 == 1, F.expr("substring(_part, length(namespace) + 2)")))
    found = named.join(bindings, [key, "namespace", "path"], "left")
    piece = F.when(F.col("_at") % 2 == 1, value_text(F.col("value"))).otherwise(F.col("_part"))
    made = found.groupBy("_row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p")))), lambda x: x["p"]), "").alias("resolved"),
        F.max(F.when(F.col("_at") == 1, F.to_json("value"))).alias("_value"),
    )
    whole = F.when(F.col(text).rlike(f"^{REFERENCE}$"), F.try_parse_json("_value"))
    return numbered.join(made, "_row").withColumn("whole", whole).drop("_row", "_value")


def workflow_outputs(declared: DataFrame, values: DataFrame) -> DataFrame:
    """(run_id, name, value as JSON text) of the declared outputs of finished workflows.

    ``declared``: run_id, name, ordinal, source, merge (null or merge_flattened), one row per
    source; ``values``: run_id, source, value (JSON text).  One source without a merge is
    its value; merge_flattened concatenates lists and other values and drops nulls; several
    sources without it are the list of their values.
    """
    got = declared.join(values, ["run_id", "source"], "left").withColumn("value", F.nullif("value", F.lit("null")))
    is_list = F.col("value").startswith("[")
    items = F.when(F.col("value").isNull(), F.array().cast("array<string>")).when(is_list, F.transform(F.from_json("value", "array<variant>"), lambda v: F.to_json(v)))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "value", items.otherwise(F.array("value")).alias("items"))))
    packed = got.groupBy("run_id", "name").agg(ordered.alias("s"), F.max("merge").alias("merge"))
    listed = lambda parts: F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))
    flat = listed(F.flatten(F.transform("s", lambda x: x["items"])))
    each = listed(F.transform("s", lambda x: F.coalesce(x["value"], F.lit("null"))))
    value = F.when(F.col("merge") == "merge_flattened", flat).when(F.size("s") == 1, F.get("s", F.lit(0))["value"]).otherwise(each)
    return packed.select("run_id", "name", value.alias("value"))


def edge_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, port, fault): edges that the graph may not have, with the first rule they break.

    ``nodes``: node, type (function, input, output); ``edges``: source, target, port.
    """
    kinds = lambda side: nodes.select(F.col("node").alias(side), F.col("type").alias(f"{side}_type"))
    both = edges.join(kinds("source"), "source", "left").join(kinds("target"), "target", "left")
    twice = F.count("*").over(Window.partitionBy("target", F.coalesce("port", F.lit("")))) > 1
    fault = (
        F.when(F.col("source_type").isNull(), "source is no declared node")
        .when(F.col("target_type").isNull(), "target is no declared node")
        .when(F.col("port") == "", "port is empty")
        .when(F.col("target_type") == "input", "an input node takes no inputs")
        .when(F.col("source_type") == "output", "an output node produces nothing")
        .when((F.col("target_type") == "function") & F.col("port").isNull(), "a function's edge names no parameter")
        .when((F.col("target_type") == "output") & F.col("port").isNotNull(), "an output's edge names a parameter")
        .when(twice, "two edges feed one parameter")
    )
    return both.select("source", "target", "port", fault.alias("fault")).where("fault IS NOT NULL")


def unfed_outputs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Output nodes that no edge feeds."""
    return nodes.where("type = 'output'").join(edges.where("port IS NULL").select(F.col("target").alias("node")), "node", "left_anti").select("node")


def node_arguments(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(node, port, value): what each function node is called with, from its sources' results.

    ``edges``: source, source_port (null: the whole result), target, port; ``results``: node,
    result (JSON text).  A port of a result that is no object or lacks it is null.
    """
    known = results.select(F.col("node").alias("source"), "result")
    got = edges.join(known, "source", "left")
    members = F.from_json("result", "map<string,variant>")
    member = F.to_json(F.try_element_at(members, F.col("source_port")))
    return got.select(F.col("target").alias("node"), "port", F.when(F.col("source_port").isNull(), F.col("result")).otherwise(member).alias("value"))


def dealt_round_robin(items: DataFrame, order: str, names: list[str]) -> DataFrame:
    """Items dealt to named partitions in turn, by their order; ``order`` is a gapless number from 0."""
    chosen = F.element_at(F.array(*map(F.lit, names)), (F.col(order) % len(names) + 1).cast("int"))
    return items.withColumn("partition", chosen)


def dealt_explicitly(items: DataFrame, key: str, assigned: DataFrame, names: list[str]) -> DataFrame:
    """Items with the partition that ``assigned`` (key, partition) names; fault where it names none or an unknown one."""
    known = items.join(assigned, key, "left")
    fault = F.when(F.col("partition").isNull(), "not assigned").when(~F.col("partition").isin(*names), "no such partition")
    return known.withColumn("fault", fault)


def merged_items(items: DataFrame, defaults: dict[str, str], key: str, inputs: str = "inputs") -> DataFrame:
    """Items (key, inputs map) with a campaign's defaults below their own inputs, which win, nulls too."""
    given = F.create_map(*[F.lit(x) for pair in sorted(defaults.items()) for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    own = F.coalesce(inputs, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(given, lambda k, _: ~F.map_contains_key(own, k))
    return items.select(key, F.map_concat(rest, own).alias(inputs))


#: What an item varies: maps are merged over the shared ones, scalars stand in for them.
ITEM_MAPS, ITEM_SCALARS = ("inputs", "files", "parameters", "environment"), ("tag", "placement", "priority", "name")


def merged_jobs(items: DataFrame, shared: Mapping[str, Mapping[str, str] | str | int | None], key: str, given: str = "given") -> DataFrame:
    """(key, ITEM_MAPS, ITEM_SCALARS) of a campaign's items over its shared values.

    An item's entries of a map win over the shared ones, nulls too.  A scalar that the item
    gives (its name is in the array ``given``) stands, null or not; else the shared one does.
    """
    out = [F.col(key)]
    for name in ITEM_MAPS:
        pairs = [F.lit(x) for pair in sorted((shared.get(name) or {}).items()) for x in pair]
        below = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        own = F.coalesce(F.col(name), F.create_map().cast("map<string,string>")) if name in items.columns else F.create_map().cast("map<string,string>")
        out.append(F.map_concat(_without(below, own), own).alias(name))
    for name in ITEM_SCALARS:
        default = F.lit(shared.get(name))
        own = F.array_contains(given, name)
        out.append((F.when(own, F.col(name)).otherwise(default) if name in items.columns else default).alias(name))
    return items.select(*out)


def _without(below: Column, own: Column) -> Column:
    return F.map_filter(below, lambda k, _: ~F.map_contains_key(own, k))


def routed(items: DataFrame, key: str, partitions: DataFrame, names: list[str], *, turn: str | None = None) -> DataFrame:
    """Items with the partition that takes them and ``fault``: by hash of the key, or in turn by the number ``turn``.

    ``partitions``: partition, remote, path, of which ``names`` is the campaign's order.  An
    item of a remote partition, or of one that nothing is known of, is refused and stays.
    """
    place = F.col(turn) % len(names) if turn else partition_of(F.col(key).cast("string"), len(names))
    chosen = items.withColumn("partition", F.element_at(F.array(*map(F.lit, names)), (place + 1).cast("int")))
    fault = F.when(F.col("remote").isNull(), "no such partition").when(F.col("remote"), "the partition is remote").when(F.col("path").isNull(), "the partition has no path")
    return chosen.join(partitions, "partition", "left").withColumn("fault", fault).drop("remote")
