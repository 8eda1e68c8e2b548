"""Connected components of a graph given as edges, by stars.

Every round first points each node at the least of its smaller neighbours, and those neighbours at
it too (small star: a window over a node's smaller neighbours, which spills), then replaces each
target by the target's own target (pointer jumping: a join on the target, of which one side is
unique, so a hub's many edges can be split by adaptive skew handling). Rounds grow with the
logarithm of the longest chain. Each round is a staged table; nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.session import stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node that has an edge; ``root`` is the least node of its component.

    Nulls and loops are ignored, repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a <> b")
    old = None
    while True:
        low = e.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        small = stage(small, "stars")
        unstage(old)
        up = small.groupBy(F.col("a").alias("t")).agg(F.min("b").alias("m"))
        joined = small.join(up, small.b == up.t, "left")
        # done when no target has a target: then every node has one target, its root
        if joined.where("t is not null").limit(1).count() == 0:
            roots = small.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        e, old = joined.select("a", F.coalesce("m", "b").alias("b")).unionByName(small.select("a", "b")).distinct(), small
