"""What goes down a tree of any depth: pointer doubling over parent links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch, stored


def propagate(nodes: DataFrame, node: str, parent: str, value: Column, separator: str = " > ", out: str = "inherited", most: int = 64) -> DataFrame:
    """nodes with the values of all their ancestors, the root's first, and their own (out), and with their depth (0 at a root).

    Each round joins a node to the ancestor its pointer shows, takes over what that one has gathered and doubles the pointer, so a tree of depth d takes log2(d) rounds; a row
    whose pointer has reached the root rests. Rounds are written, so lineage stays one round long. A parent of many children is a skewed join, which
    AQE splits, as the other side has one row a node. Null values are passed over; a parent that is not there counts as none; node ids are unique and not null; a circle raises an error.
    """
    at = scratch(nodes.sparkSession, "propagate")
    first = nodes.select(F.col(node).alias("id"), F.col(parent).alias("up"), value.cast("string").alias("text"))
    ids = first.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    first = first.join(ids, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), "text", F.when(F.col("known"), 1).otherwise(0).alias("depth"))
    now = stored(first, f"{at}/0")
    done, rounds = [], 0
    while not now.filter("up IS NOT NULL").isEmpty():
        rounds += 1
        if 2**rounds > 2 ** (math.ceil(math.log2(most)) + 8):
            raise ValueError("the parent links have a circle")
        done.append(now.filter("up IS NULL"))
        rest = done[0]
        for x in done[1:]:
            rest = rest.unionByName(x)
        above = rest.unionByName(now.filter("up IS NOT NULL")).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("text").alias("before"), F.col("depth").alias("more"))
        step = now.filter("up IS NOT NULL").join(above, "up").select("id", F.col("next").alias("up"), F.concat_ws(separator, "before", "text").alias("text"), (F.col("depth") + F.col("more")).alias("depth"))
        now = stored(step, f"{at}/{rounds}")
    whole = now
    for x in done:
        whole = whole.unionByName(x)
    return nodes.join(whole.select(F.col("id").alias(node), F.col("text").alias(out), "depth"), node)
