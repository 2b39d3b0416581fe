"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compassframe.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the component's smallest node) for every node of the edges a, b; null ends are ignored.

    Each round hangs the neighbours of a node on the smallest of them; minima are taken before rows move and the
    joins are between tables of edges, so a node of many links is no task of its own. Rounds end when no edge changes.
    """
    now = scratch.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), f"{name}0")
    k, before = 0, None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        large = scratch.put(large, f"{name}{k}l")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hung = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = hung.union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        k += 1
        now = scratch.put(small, f"{name}{k}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
