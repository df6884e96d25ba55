"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, shuffled


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b), ids of one orderable type -> (node, root), root the least id reachable.

    Only nodes that have an edge to another node are returned. Every round is
    min-aggregations (partial on the map side) and equi-joins whose large side adaptive
    execution can split; nothing is gathered per node or broadcast. Nulls in a or b make no edge; an
    empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = scratch.save(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state or sign[0] == 0:
            break
        state = sign
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(shuffled(least), "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least), "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = scratch.save(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(now)
        now = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))  # one row a node: small-star's fixed point
    return stars.union(now.select("b", "b").distinct())
