"""Connected components of a graph given as a table of edges, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansight.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of an edge (src, dst); a component is named by its smallest node.

    Alternates two steps until nothing changes: every node links its larger neighbours to the
    smallest node around it, then its smaller neighbours. Depths halve, so the rounds grow with
    the logarithm of the longest path. Minima are partly taken before each shuffle, which
    takes the weight off hubs, and each round is a written table that replaces the one before.
    """
    now = edges.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, mark, turn = scratch.save(now, f"{name}-0"), None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or (state["n"], state["s"]) == mark:
            break
        mark = (state["n"], state["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now, turn = scratch.save(following, f"{name}-{turn + 1}"), turn + 1
        scratch.drop(f"{name}-{turn - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
