"""Connected components of a link table, without collecting links or nodes.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step replaces
links by links to the least neighbour, found with a pre-aggregated minimum and a join that
Spark may split where a node has very many links.  Every step is written to shared storage,
so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def _to_least(links: DataFrame, only_smaller: bool) -> DataFrame:
    """Each node's links, hung on the least node among itself and its neighbours.

    only_smaller: neighbours are those below the node (small star), else all, and only
    those above it are hung anew (large star).  A link may come out more than once.
    """
    if only_smaller:
        pairs = links
    else:
        pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    moved = pairs if only_smaller else pairs.where("b > a")
    hung = moved.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if only_smaller:
        hung = hung.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return hung.where("a > b")


def _unsettled(edges: DataFrame) -> int:
    """Nodes that keep the links from being stars: with several lesser nodes, or one and greater ones too."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return nodes.agg(F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1)))).first()[0]


def connected_components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(id, component): every linked node with the least node that it can reach.

    Links may repeat, run either way and join a node to itself (which adds nothing); nodes
    without links to others are absent; a null end links nothing.  No links: no rows.
    Steps go on until the links are stars around the least nodes; their number grows with
    the logarithm of the number of nodes.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges, path = scratch.table(edges.distinct())
    open_ = _unsettled(edges)
    while open_:
        edges, next_path = scratch.table(_to_least(_to_least(edges, False), True).distinct())
        scratch.drop(path)
        path, open_ = next_path, _unsettled(edges)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
