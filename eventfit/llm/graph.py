"""Connected components by contraction, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Pointer doublings in each round; a chain of 2**JUMPS nodes becomes one node.
JUMPS = 3


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace each label by its parent, if it has one."""
    p = parents.select(F.col("id").alias("label"), F.col("parent"))
    return labels.join(p, "label", "left").select("id", F.coalesce("parent", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every node of ``edges(a, b)``; label: smallest id reachable.

    Each round points every node at its smallest neighbour (a combined
    aggregate, so a hub's edges are reduced before the shuffle), shortens
    the chains by pointer doubling, and maps the edges onto the nodes
    reached. Self loops and repeated edges fall away, so the graph shrinks
    every round until no edge is left. All tables stay distributed and each
    round's are written to the shared folder, whose plain scans let Spark
    split a hot join key.
    """
    todo = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not todo.isEmpty():
        both = todo.unionByName(todo.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent"))
                         .select("id", F.least("id", "parent").alias("parent")), "parents")
        step = parents.select("id", F.col("parent").alias("label"))
        for _ in range(JUMPS):
            step = settle(_follow(step, step.select("id", F.col("label").alias("parent"))), "jump")
        up = step.select("id", F.col("label").alias("parent"))
        labels = step if labels is None else settle(_follow(labels, up), "labels")
        a = up.select(F.col("id").alias("a"), F.col("parent").alias("pa"))
        b = up.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        todo = settle(todo.join(a, "a").join(b, "b").where("pa <> pb")
                      .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return todo.select(F.col("a").alias("id"), F.col("b").alias("label")) if labels is None else labels
