"""Connected components of a graph in a DataFrame, by alternating stars.

Each round turns every node towards the least node around it: first (large star)
the greater neighbours of each node are linked to the least of its neighbourhood,
then (small star) each node with the lesser ones. The rounds end when no edge
changes; their number grows with the logarithm of the nodes. Nothing but two
numbers per round comes to the driver, and each round's edges are written to the
shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _mark(edges: DataFrame):
    """Number of edges and a sum that depends on all of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own: then both sides of the join are dealt out anew, and Spark can split a node with very many edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m")), "least")
    return (both.join(least, F.col("u") == F.col("at")).where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    # every edge goes from the greater node u to the lesser v
    edges = written(edges, "large")
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m"), "least")
    moved = edges.join(least, F.col("u") == F.col("at")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (columns a, b; longs),
    the root itself included. The root is the least node of the component.

    Loops, repeated edges and either direction are fine; an edge with a null end
    counts for nothing. No edges: no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before and mark[0]:
        now = written(_small(_large(now)), "edges")
        before, mark = mark, _mark(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
