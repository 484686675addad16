"""Connected components by repeated contraction of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """Labels every node of edges (a, b) with the least node reachable from it: columns node, root.

    Every round each node moves to its least neighbour (or stays), which contracts the graph; edges within one
    node vanish, so rounds end when none is left. Tables of earlier rounds are deleted. Self-loops and repeated
    edges do not matter, null ends are left out; no edges give no rows.
    """
    edges = staged(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "moves")
        # A node whose least neighbour moves itself follows it: one step of pointer jumping.
        over = first.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moves = staged(first.join(over, "root").select("node", F.col("next").alias("root")), "moves")
        before, labels = labels, moves
        if before is not None:
            labels = staged(before.join(moves.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        a, b = moves.select(F.col("node").alias("a"), F.col("root").alias("a2")), moves.select(F.col("node").alias("b"), F.col("root").alias("b2"))
        shorter = staged(edges.join(a, "a").join(b, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
        unstage(edges, first, before, moves if labels is not moves else None)
        edges = shorter
        if edges.isEmpty():
            unstage(edges)
            return labels
