"""Connected components of an edge table, by contraction on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import staged


def roots(parent: DataFrame) -> DataFrame:
    """(id, up) with up < id: each id with the last of its chain of ups."""
    while True:
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("higher"))
        jumped = staged(parent.join(above, "up", "left"), "components-jump")
        if jumped.filter("higher IS NOT NULL").isEmpty():
            return parent
        parent = jumped.select("id", F.coalesce("higher", "up").alias("up"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b); component is the smallest id reachable.

    Each round hangs every node under its smallest neighbour where that is smaller,
    follows the chains to their ends, and puts those in the edges' place. Rounds grow
    with the logarithm of the longest path. Minima are combined map side.
    """
    edges = staged(edges.filter("a <> b").select("a", "b").distinct(), "components-edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = staged(labels.select("id", F.col("id").alias("component")), "components-labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).filter("up < id")
        parent = staged(roots(staged(parent, "components-parent")), "components-roots")
        at = lambda df, c: df.join(parent.select(F.col("id").alias(c), F.col("up").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        labels = staged(at(labels, "component"), "components-labels")
        edges = staged(at(at(edges, "a"), "b").select("a", "b").filter("a <> b").distinct(), "components-edges")
    return labels.select("id", "component")
