"""Connected components of an edge table, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import common

#: A node of more neighbours than this, and than this share of all edges, is a hub.
HUB_EDGES, HUB_SHARE = 1000, 100_000

#: Edges of one file of a round's table, about, and files at least (or as many as there are).
PART_EDGES, LEAST_PARTS = 250_000, 8


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m of their node u from least (u, m, degree).

    Hubs, at most twice HUB_SHARE of them whatever the input, are broadcast, so their many edges stay where they are; only the
    other edges are dealt by node.
    """
    bound = max(HUB_EDGES, n // HUB_SHARE)
    hubs = least.filter(F.col("degree") > bound).select("u", F.col("m").alias("_hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    direct = marked.filter(F.col("_hub").isNotNull()).select("u", "v", F.col("_hub").alias("m"))
    others = marked.filter(F.col("_hub").isNull()).select("u", "v")
    return direct.unionByName(others.join(least.filter(F.col("degree") <= bound).select("u", "m"), "u").select("u", "v", "m"))


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component (the smallest node) for every node of an edge; loops and repeated edges are harmless.

    A round links each node's larger neighbours to its smallest one, then its smaller ones; every component becomes a star
    around its smallest node in a number of rounds that grows as the logarithm of its size, squared at worst. Edges stay in
    tables: the driver sees a count and a checksum a round.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter(u != v)
    pairs = common.cut(pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    seen = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        n = state[0]
        if state == seen or not n:
            break
        seen = state
        both = pairs.unionByName(pairs.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, n).filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        linked = _with_least(large, least, n)
        small = linked.select(F.explode(F.array(F.struct(v.alias("u"), F.col("m").alias("v")), F.struct(u.alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = common.cut(small.select("e.u", "e.v").filter(u != v).distinct().coalesce(max(LEAST_PARTS, n // PART_EDGES)))
    leaves = pairs.select(u.alias("node"), v.alias("component"))
    return leaves.unionByName(pairs.select(v.alias("node"), v.alias("component")).distinct())
