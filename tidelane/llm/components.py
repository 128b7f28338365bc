"""Connected components of an undirected graph, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node long, root long) for every node of edges (a long, b long); root is the least node.

    Edges are contracted first: a node keeps one edge, to the least of its b's, and its other
    b's are tied to that one. Where many nodes share few b's, as the members of a group
    share the least members of its buckets, that leaves one edge a node and a small core.
    Rounds then run on the core alone: each takes the least root among the neighbours and
    after that the root's own root. Aggregates combine before the shuffle and joins are
    plain equi-joins, which Spark splits where one node has many edges. Self-loops and
    repeated edges do no harm.
    """
    edges = cut(edges.select("a", "b").distinct())
    stem = cut(edges.groupBy("a").agg(F.min("b").alias("stem")))
    targets = cut(edges.select(F.col("b").alias("node")).distinct())
    ties = edges.join(stem, "a").filter("b != stem").select(F.col("b").alias("a"), F.col("stem").alias("b"))
    own = stem.join(targets, stem["a"] == targets["node"], "left_semi").filter("a != stem").select("a", F.col("stem").alias("b"))
    core = ties.union(own).distinct()
    both = cut(core.union(core.select("b", "a")).distinct())
    found = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while not found.isEmpty():
        near = both.join(found.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = found.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        above = found.select(F.col("node").alias("low"), F.col("root").alias("above"))
        found = cut(low.join(above, "low").select("node", "was", F.least("low", "above").alias("root")))
        if found.filter("root != was").isEmpty():
            break
    named = cut(targets.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("top")))
    leaves = stem.join(targets, stem["a"] == targets["node"], "left_anti")
    leaves = leaves.join(named.select(F.col("node").alias("stem"), "top"), "stem").select(F.col("a").alias("node"), "top")
    every = cut(named.union(leaves))
    least = every.groupBy("top").agg(F.min("node").alias("root"))  # a leaf may be less than the core
    return every.join(least, "top").select("node", "root")
