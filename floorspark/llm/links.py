"""Connected components by joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorspark.plans.skew import lookup_join
from floorspark.session import stored


def _hooked(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours, followed thrice."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
    parent = stored(parent, "parents")
    root = parent
    for _ in range(2):
        step = root.select(F.col("a").alias("p"), F.col("p").alias("q"))
        root = root.join(step, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
    return stored(root, "roots")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of the links (a, b); equal labels: connected.

    Each round hooks every node to its least neighbour and contracts the graph,
    which at least halves the nodes that still have links.
    """
    edges = stored(edges.where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        root = _hooked(edges)
        if labels is None:
            labels = root.select(F.col("a").alias("id"), F.col("p").alias("label"))
        else:
            step = root.select(F.col("a").alias("label"), F.col("p").alias("next"))
            labels = lookup_join(labels, step, ["label"]).select("id", F.coalesce("next", "label").alias("label"))
            labels = stored(labels, "labels")
        for side in ("a", "b"):
            step = root.select(F.col("a").alias(side), F.col("p").alias("to"))
            other = "b" if side == "a" else "a"
            edges = edges.join(step, side, "left").select(F.coalesce("to", side).alias(side), other)
        edges = stored(edges.where("a <> b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
