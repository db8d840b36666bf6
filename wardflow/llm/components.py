"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.functions.runtime import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node but the roots; root is the smallest id of the node's component.

    ``edges``: a, b in any order, repeats and loops allowed. Alternates large-star and small-star steps,
    each a map-side combined minimum by node and one join, until every edge points at a root. Links stay
    in the cluster; the driver only learns whether a step changed anything.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    while True:
        # A star forest: each node has one neighbour, and no neighbour has one of its own.
        uneven = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not uneven and not e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count():
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.filter("a <> b").distinct(), "edges")
