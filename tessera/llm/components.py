"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable, join_unique


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """edges: a, b (longs, no nulls). Returns node, root for every node that has an edge to another.

    Each round writes its edges to the shared folder and drops those before, so lineage stays one round long; the driver sees
    counts only. The centre of a large star is a hot key: its least neighbour comes by broadcast (join_unique).
    The number of rounds grows with the logarithm of the largest component.
    """
    e = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    least = lambda x: x.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_unique(both, least(both), ["u"], "n", 2 * before[0]).filter("v > u")
        large = durable(large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), f"{name}-large")
        low = least(large)
        small = join_unique(large, low, ["u"], "n", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(e)
        drop(large)
        e, after = now, mark(now)
        if after == before:
            break
        before = after
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
