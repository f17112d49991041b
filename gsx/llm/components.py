"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a vertex with many neighbours is
pre-aggregated before the shuffle and split by the adaptive skew join after it.
The state of every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gsx.session import settle


def _star(directed: DataFrame) -> DataFrame:
    """(node, low): the smallest neighbour of every node."""
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; ``root`` is the smallest node reachable.

    Nodes are integers.  NULL ends and loops are ignored; repeated edges and an empty
    table are allowed (the result is then empty).
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    e = settle(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(
            both.join(_star(both).withColumn("m", F.least("u", "m")), "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        low = _star(large)
        small = large.join(low, "u").filter(F.col("v") != F.col("m"))
        e = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(e: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
