"""Connected components of a table of links, by hooking and contracting.

Every node hooks onto its smallest smaller neighbour, which gives a forest; its pointers are doubled until all
reach a root, the links are carried over to roots, and what is left is contracted in the same way. The
smallest node of a component never hooks, so it ends as the root. Nothing is collected; each round is a
written table.

Defined cases: loops, repeated links and either direction are alike; no links give an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineform.llm import common


def _resolved(forest: DataFrame) -> DataFrame:
    """node, root: pointers doubled until no root is itself a node that points on."""
    while True:
        up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
        forest = common.stored(forest.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if forest.where("moved").isEmpty():
            return forest.select("node", "root")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node that isn't a root; links: columns a and b."""
    edges = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    done = None
    while not edges.isEmpty():
        forest = _resolved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        if done is None:
            done = forest
        else:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            done = done.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).unionByName(forest)
        a = forest.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = forest.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        carried = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        edges = common.stored(carried.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if done is None else common.stored(done)
