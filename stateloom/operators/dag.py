"""Dataflow graphs: levels, readiness, poisoning; scatter, gather, merges.

Levels and poison are one computation (``settled``): a node is known once all its parents
are, one round later than the last.  Going round by round costs as many rounds as the graph
is deep, so nodes that wait for one parent only are contracted: what such a node becomes is
a function of its parent, functions along a chain compose, and pointers of doubling length
reach the chain's head in a logarithmic number of steps.  Rounds remain for nodes with
several open parents; each folds what it has learnt, so they become nodes with one.  Every
step is distributed and written to shared storage, so plans do not grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_table

#: What a parent means to a child, the graver the higher: nothing, failure, a stop, or that it never settles.
FINE, FAILED, STOPPED, NEVER = 0, 1, 2, 3
#: Each node's fate as it follows from the fates of its parents, and the round in which it is known.
_EDGE = ("child", "parent", "if_failed", "if_stopped", "least", "steps")


def _dealt(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: broadcast, what grows with the graph would pass through the driver in every round."""
    return df.hint("merge")


def _own(code: Column, tolerant: Column) -> Column:
    """What a node becomes, from the gravest of its parents: one that can run never settles here."""
    return F.when(code >= STOPPED, code).when((code == FAILED) & ~tolerant, FAILED).otherwise(NEVER)


def _through(fate: Column, if_failed: Column, if_stopped: Column) -> Column:
    return F.when(fate == FAILED, if_failed).when(fate == STOPPED, if_stopped).otherwise(NEVER)


def _merged(edges: DataFrame) -> DataFrame:
    """One edge for each pair: what several mean to a child is the gravest and the latest of them."""
    return edges.groupBy("child", "parent").agg(*[F.max(c).alias(c) for c in (*_EDGE[2:], "tolerant")])


def _doubled(chain: DataFrame) -> DataFrame:
    """Each chain node with the head of its chain, which is none, and what it becomes by the head's fate.

    ``chain``: node, to, if_failed, if_stopped, least, steps.  Nodes that only lead round a
    circle are left out: they never settle.
    """
    n = chain.count()
    at, length = chain, 1
    while True:
        ahead = at.select(F.col("node").alias("_node"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in _EDGE[2:]])
        moves = F.col("_node").isNotNull()
        joined = at.join(_dealt(ahead), F.col("to") == F.col("_node"), "left")
        least = F.greatest("least", F.col("_least") + F.col("steps"))
        made = joined.select(
            "node",
            F.coalesce("_to", "to").alias("to"),
            F.when(moves, _through(F.col("_if_failed"), F.col("if_failed"), F.col("if_stopped"))).otherwise(F.col("if_failed")).alias("if_failed"),
            F.when(moves, _through(F.col("_if_stopped"), F.col("if_failed"), F.col("if_stopped"))).otherwise(F.col("if_stopped")).alias("if_stopped"),
            F.when(moves, least).otherwise(F.col("least")).alias("least"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            moves.alias("moved"),
        )
        made = scratch_table(made)
        at = made.drop("moved")
        if made.where("moved").isEmpty():
            return at
        if length > n:  # longer than any chain: what still moves goes round
            return at.join(_dealt(chain.select(F.col("node").alias("to"))), "to", "left_anti")
        length *= 2


def settled(edges: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(node, fate, turn) of the nodes that come to fail or stop because of their parents.

    ``edges``: parent, child, barrier (a barrier only has to settle); ``nodes``: node,
    tolerant, of the open nodes; ``known``: node, fate (FINE, FAILED or STOPPED), of the others.
    A parent that is neither open nor known never settles.
    """
    bad = lambda code: F.when(F.col("barrier"), F.lit(FINE)).otherwise(F.lit(code))
    waiting = edges.join(_dealt(nodes.select(F.col("node").alias("child"), "tolerant")), "child")
    waiting = waiting.select("child", "parent", "tolerant", bad(FAILED).alias("if_failed"), bad(STOPPED).alias("if_stopped"), F.lit(0).cast("long").alias("least"), F.lit(1).cast("long").alias("steps"))
    waiting = scratch_table(_merged(waiting))
    new = known.select(F.col("node").alias("parent"), "fate", F.lit(0).cast("long").alias("turn"))
    base, found, hung = None, [], []
    while True:
        # What the new fates mean to their children, on top of what these knew before.
        met = waiting.join(_dealt(new), "parent", "left")
        means = F.when(F.col("fate") == FINE, FINE).otherwise(_through(F.col("fate"), F.col("if_failed"), F.col("if_stopped")))
        told = F.col("fate").isNotNull()
        facts = met.select(
            "child", "tolerant", F.when(told, means).alias("code"), F.when(told, F.greatest("least", F.col("turn") + F.col("steps"))).alias("at"), F.when(told, 0).otherwise(1).alias("open"),
            F.when(~told, F.struct(*_EDGE[1:])).alias("edge"),
        )
        if base is not None:
            facts = facts.unionByName(base.select("child", "tolerant", "code", "at", F.lit(0).alias("open")), allowMissingColumns=True)
        # any_value of the open edges: the only one, where a node has one.
        folded = facts.groupBy("child").agg(F.max("tolerant").alias("tolerant"), F.max("code").alias("code"), F.max("at").alias("at"), F.sum("open").alias("open"), F.any_value("edge", ignoreNulls=True).alias("edge"))
        state = scratch_table(folded)
        own = _own(F.coalesce("code", F.lit(FINE)), F.col("tolerant"))
        is_ready = (F.col("open") == 0) & (own < NEVER)
        ready = state.where(is_ready).select(F.col("child").alias("node"), own.alias("fate"), F.col("at").alias("turn"))
        counts = state.agg(F.count_if(is_ready).alias("ready"), F.count_if(F.col("open") == 1).alias("single")).first()
        if not counts.ready:
            break
        found.append(ready)
        rest = met.where(~told).select(*_EDGE, "tolerant")
        # Contracted are chains of more than one node, where they hold more nodes than the round has settled.
        single, inner = state.where("open = 1"), 0
        if counts.single >= 4 * counts.ready:
            inner = single.join(_dealt(single.select(F.col("child").alias("_up"))), F.col("edge.parent") == F.col("_up"), "left_semi").count()
        if inner > counts.ready:
            chain = scratch_table(single.select(
                F.col("child").alias("node"),
                F.col("edge.parent").alias("to"),
                *[_own(F.greatest(F.coalesce("code", F.lit(FINE)), F.col(f"edge.{c}")), F.col("tolerant")).alias(c) for c in ("if_failed", "if_stopped")],
                F.greatest(F.coalesce("at", F.lit(0)), "edge.least").alias("least"),
                F.col("edge.steps").alias("steps"),
            ))
            heads = _doubled(chain)
            hung.append(heads)
            outside = rest.join(_dealt(chain.select(F.col("node").alias("child"))), "child", "left_anti")
            up = heads.select(F.col("node").alias("parent"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in _EDGE[2:]])
            # An edge from a chain node is one from its head; from a circle none, so its child stays open.
            moved = outside.join(_dealt(up), "parent", "left")
            through = lambda c: F.when(F.col("_to").isNull(), F.col(c)).otherwise(_through(F.col(f"_{c}"), F.col("if_failed"), F.col("if_stopped"))).alias(c)
            rest = _merged(moved.select(
                "child", "tolerant", F.coalesce("_to", "parent").alias("parent"), through("if_failed"), through("if_stopped"),
                F.greatest("least", F.coalesce(F.col("_least") + F.col("steps"), F.lit(0))).alias("least"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            ))
            state = state.where("open <> 1")  # what chain nodes know is in the chain
        base = state.where("open > 0 AND code IS NOT NULL")
        waiting, new = scratch_table(rest), ready.select(F.col("node").alias("parent"), "fate", "turn")
    # Nodes of chains follow from their heads; a later chain may hold the heads of an earlier one.
    fates = known.select("node", "fate", F.lit(0).cast("long").alias("turn"))
    for part in found:
        fates = fates.unionByName(part)
    for heads in reversed(hung):
        fates = scratch_table(fates)
        below = heads.join(_dealt(fates.select(F.col("node").alias("to"), F.col("fate").alias("_fate"), "turn")), "to")
        fate = _through(F.col("_fate"), F.col("if_failed"), F.col("if_stopped"))
        fates = fates.unionByName(below.select("node", fate.alias("fate"), F.greatest("least", F.col("turn") + F.col("steps")).alias("turn")).where(F.col("fate") < NEVER))
    return scratch_table(fates).join(_dealt(nodes.select("node")), "node", "left_semi")


def dag_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path from a root; a cycle is an error.

    Chains take a logarithmic number of steps; the rounds beside them are as many as there
    are layers of nodes with several parents that are open at once.
    """
    pairs = scratch_table(edges.select("parent", "child").distinct())
    children = scratch_table(pairs.select(F.col("child").alias("node")).distinct())
    roots = scratch_table(pairs.select(F.col("parent").alias("node")).distinct().join(_dealt(children), "node", "left_anti"))
    # A level is the round in which a failure at the roots would reach a node.
    failed = roots.withColumn("fate", F.lit(FAILED))
    reached = settled(pairs.withColumn("barrier", F.lit(False)), children.withColumn("tolerant", F.lit(False)), failed)
    placed = scratch_table(roots.withColumn("level", F.lit(0).cast("long")).unionByName(reached.select("node", F.col("turn").alias("level"))))
    if (lost := roots.count() + children.count() - placed.count()) > 0:
        raise ValueError(f"the graph has a cycle: {lost} nodes have no level")
    return placed


def dag_ready(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Pending nodes all of whose parents are settled, in name order.  states: node, state."""
    settled = F.col("state").isin("completed", "failed", "skipped")
    open_parents = edges.join(states.select(F.col("node").alias("parent"), settled.alias("settled")), "parent", "left").where("NOT coalesce(settled, false)")
    return states.where("state = 'pending'").join(open_parents.select(F.col("child").alias("node")).distinct(), "node", "left_anti").orderBy("node")


# States of nodes that change no more.
SETTLED = {"completed": FINE, "skipped": FINE, "failed": FAILED, "stopped": STOPPED}


def dag_poison(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(node, fate, turn): pending nodes that will never run, and the round in which that is known.

    ``edges``: parent, child, barrier (a barrier only has to settle).  ``states``: node,
    state, tolerant (its missing inputs are no error).  A node is judged once all its
    parents and barriers are settled: it stops if a parent stopped, and fails if a parent
    failed and it is not tolerant; either settles it for its own children.  A parent without
    a state is not settled.
    """
    code = F.coalesce(*[F.when(F.col("state") == name, value) for name, value in SETTLED.items()])
    pending = states.where("state = 'pending'").select("node", F.coalesce("tolerant", F.lit(False)).alias("tolerant"))
    known = states.select("node", code.alias("fate")).where("fate IS NOT NULL")
    fate = F.when(F.col("fate") == STOPPED, "stopped").otherwise("failed")
    return settled(edges.select("parent", "child", "barrier"), pending, known).select("node", fate.alias("fate"), "turn")


def duplicate_ports(edges: DataFrame) -> DataFrame:
    """(target, port) pairs that more than one edge feeds."""
    return edges.groupBy("target", "port").agg(F.count("*").alias("n")).where("n > 1")


def scatter(rows: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Dot-product scatter: one row per place of equally long arrays; unequal lengths are an error."""
    sizes = [F.size(a) for a in arrays]
    equal = sizes[0] == sizes[0]
    for s in sizes[1:]:
        equal = equal & (sizes[0] == s)
    checked = F.when(equal, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("scattered arrays differ in length")))
    return rows.select(*keys, F.posexplode(checked).alias("shard", "_item")).select(*keys, "shard", "_item.*")


def gather(shards: DataFrame, parents: DataFrame, key: str, value: str) -> DataFrame:
    """Results as arrays in shard order; parents without shards get an empty array."""
    lists = shards.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shard", F.col(value).alias("v")))).alias("_s"))
    kind = shards.schema[value].dataType.simpleString()
    gathered = F.coalesce(F.transform("_s", lambda x: x["v"]), F.array().cast(f"array<{kind}>"))
    return parents.select(key).distinct().join(lists, key, "left").select(key, gathered.alias(value))


def link_merge(sources: DataFrame, key: str, default: Column | None = None) -> DataFrame:
    """merge_flattened: the arrays of several sources by ordinal, one level flattened, nulls dropped.

    ``sources``: key, ordinal, items (array).  ``default`` stands in only for a null result.
    """
    lists = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "items"))).alias("_s"))
    flat = F.filter(F.flatten(F.transform("_s", lambda x: x["items"])), lambda v: v.isNotNull())
    return lists.select(key, (F.coalesce(flat, default) if default is not None else flat).alias("items"))


def truthy(value: Column, kind: str) -> Column:
    """Whether a skip condition holds: null, false, 0, '' and [] do not."""
    empty = {"boolean": value == F.lit(False), "string": value == "", "array": F.size(value) == 0}.get(kind, value == 0)
    return value.isNotNull() & ~empty


def argument_words(kind: Column, prefix: Column, separate: Column, item_separator: Column, items: Column) -> Column:
    """The words (array) of one argument from its values as texts (``items``: array, one value otherwise).

    A true boolean is its prefix, a false one nothing.  An array with an item separator is
    one word, joined; without one, every item is a word, and the prefix stands once before
    them.  A prefix stands apart unless ``separate`` is false, when it is put before the
    first word.  No value or an empty array gives nothing.
    """
    none = F.array().cast("array<string>")
    before = F.when(F.coalesce(prefix, F.lit("")) != "", F.array(prefix)).otherwise(none)
    words = F.when((kind == "array") & item_separator.isNotNull(), F.array(F.call_function("array_join", items, item_separator))).otherwise(items)
    first = F.concat(F.coalesce(prefix, F.lit("")), F.get(words, F.lit(0)))
    glued = F.concat(F.array(first), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))
    valued = F.when(F.coalesce(separate, F.lit(True)), F.concat(before, words)).otherwise(glued)
    flag = F.when(F.get(items, F.lit(0)) == "true", before).otherwise(none)
    return F.when(items.isNull() | (F.size(items) == 0), none).when(kind == "boolean", flag).otherwise(valued)


def arguments(rows: DataFrame, key: str) -> DataFrame:
    """(key, argv): argument words by (position, declaration index), spaced.

    ``rows``: key, position (nullable, counts 0), declared, and what ``argument_words`` takes:
    kind, prefix, separate, item_separator, items.
    """
    words = argument_words(*(F.col(c) for c in ("kind", "prefix", "separate", "item_separator", "items")))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(0)).alias("p"), "declared", words.alias("w"))))
    return rows.groupBy(key).agg(ordered.alias("_w")).select(key, F.array_join(F.flatten(F.transform("_w", lambda x: x["w"])), " ").alias("argv"))
