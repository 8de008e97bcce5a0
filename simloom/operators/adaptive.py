"""Adaptive buckets: keys share a bucket while it is small, and are told apart by more of their bits where it is not.

A key's path runs from its segment (the bits above bucket_bits) through slots of some bits a level, the highest first. A
bucket that overflows is split one level down, until the last level. ``count`` mode splits every bucket of more than
overflow keys, whatever their order; ``order_exact`` follows the arrival of keys one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import hashing
from simloom.operators import search
from simloom.sources import shared


@dataclass(frozen=True)
class Geometry:
    """Bits of the key, bits under the segment, slots of a directory, and the entries that a bucket takes before it splits."""

    bucket_bits: int = 28
    directory_size: int = 128
    hash_bits: int = 32
    overflow: int = 4

    @property
    def level_bits(self) -> int:
        return self.directory_size.bit_length() - 1

    @property
    def top_level(self) -> int:
        return (self.hash_bits - (32 - self.bucket_bits)) // self.level_bits - 1

    def __post_init__(self):
        if self.directory_size & (self.directory_size - 1) or self.directory_size < 2:
            raise ValueError("a directory has a power of two of slots")
        if not 0 < self.bucket_bits <= 32 or self.top_level < 0 or self.overflow < 1:
            raise ValueError("no level is left, or no overflow")


def path(key: Column, geometry: Geometry) -> list[Column]:
    """The path's names, one for each depth: the segment with the first slot, then with a slot more each."""
    h = hashing.unsigned32(key)
    if geometry.hash_bits < 32:
        h = F.shiftright(h, 32 - geometry.hash_bits)
    parts, out = [F.shiftright(h, geometry.bucket_bits).cast("string")], []
    for level in range(geometry.top_level, -1, -1):
        parts.append(F.shiftright(h, level * geometry.level_bits).bitwiseAND(geometry.directory_size - 1).cast("string"))
        out.append(F.concat_ws("/", *parts))
    return out


def assign_leaves(index: DataFrame, geometry: Geometry | None = None, mode: str = "count", arrival: str = "vector_id", partition: str | None = None) -> DataFrame:
    """index with leaf, the name of the bucket each vector is in, and depth.

    In count mode a prefix is split if it is crowded, and every prefix of a crowded one is crowded too; so a vector's depth is one
    more than the crowded prefixes on its path, which come from counts combined before the shuffle and one join. order_exact
    follows arrivals level by level (see split_in_order); arrival tells the rows of a table apart.
    """
    geometry = geometry or Geometry()
    group = ["table_id"] + ([partition] if partition else [])
    if mode not in ("count", "order_exact"):
        raise ValueError(f"unknown mode {mode!r}")
    names = path(F.col("bucket_key"), geometry)
    row = list(dict.fromkeys([*group, "vector_id", "bucket_key"]))
    if len(names) == 1:
        out = index.withColumn("_depth", F.lit(1))
    else:
        prefixes = index.select(*row, F.explode(F.array(*names[:-1])).alias("_p"))
        crowded = prefixes.groupBy(*group, "_p").agg(F.count("*").alias("_n")).filter(F.col("_n") > geometry.overflow).drop("_n")
        if mode == "order_exact":
            crowded = split_in_order(index, geometry, group, arrival, crowded)
        split = prefixes.join(crowded, [*group, "_p"]).groupBy(*row).agg(F.count_distinct("_p").alias("_splits"))
        out = index.join(split, row, "left").withColumn("_depth", F.coalesce(F.col("_splits"), F.lit(0)) + 1)
    depth = F.col("_depth").cast("int")
    return out.select(*index.columns, F.get(F.array(*names), depth - 1).alias("leaf"), depth.alias("depth"))


def split_in_order(index: DataFrame, geometry: Geometry, group: list[str], arrival: str, crowded: DataFrame) -> DataFrame:
    """(group, _p): the buckets that split when entries arrive one by one.

    A bucket splits when an entry arrives at more than the larger of overflow and what it held when it was made, which is what
    had arrived by the time its parent split. So it splits at the arrival of its entry number overflow + 1, or, made with more
    than that, at the first arrival after it was made. Both are sums and smallest values that combine before a shuffle, a level
    at a time; only entries whose bucket has split go on to the next level.
    """
    names = path(F.col("bucket_key"), geometry)
    held = list(dict.fromkeys([*group, arrival]))
    level = index.select(*held, F.array(*names).alias("_path"), F.lit(None).cast(index.schema[arrival].dataType).alias("_since"))
    found, at = None, [*group, "_p"]
    for d in range(len(names) - 1):
        rows = level.withColumn("_p", F.get("_path", F.lit(d))).join(crowded, at, "left_semi")
        stats = rows.groupBy(*at).agg(
            F.count("*").alias("_n"), F.count_if(F.col(arrival) <= F.col("_since")).alias("_made"), F.min(F.when(F.col(arrival) > F.col("_since"), F.col(arrival))).alias("_next")
        ).filter(F.col("_n") > F.greatest(F.lit(geometry.overflow), F.col("_made")))
        rank = F.row_number().over(Window.partitionBy(*at).orderBy(arrival))
        filled = rows.select(*dict.fromkeys([*at, arrival])).withColumn("_r", rank).filter(F.col("_r") <= geometry.overflow + 1).filter(F.col("_r") == geometry.overflow + 1)
        filled = filled.select(*at, F.col(arrival).alias("_filled"))
        when = F.when(F.col("_made") <= geometry.overflow, F.col("_filled")).otherwise(F.col("_next"))
        split = shared.cut(stats.join(filled, at).select(*at, when.alias("_at")))
        found = split.select(*at) if found is None else found.unionByName(split.select(*at))
        level = rows.join(split, at).select(*held, "_path", F.col("_at").alias("_since"))
        if d + 2 < len(names):
            level = shared.cut(level)
    return found


def candidates(assigned: DataFrame, partition: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (query_id, neighbor_id) of different vectors that share a leaf of some table; queries are rows of assigned, or all of them."""
    bucket = ["table_id"] + ([partition] if partition else []) + ["leaf"]
    return search.candidates(assigned if queries is None else queries, assigned, bucket=bucket)


#: Levels of tagged prefixes, and bits of each.
PREFIX_LEVELS, PREFIX_BITS = 4, 8


def tagged_prefix(key: Column, level: int) -> Column:
    """The key's first (level + 1) groups of eight bits under a tag that names the level, as a long."""
    width = PREFIX_BITS * (level + 1)
    return F.shiftright(hashing.unsigned32(key), 32 - width).bitwiseOR((level + 1) << 32)


def prefix_probes(index: DataFrame) -> DataFrame:
    """One row for each level of each entry: (table_id, vector_id, level, prefix_key)."""
    tags = F.array(*[tagged_prefix(F.col("bucket_key"), k) for k in range(PREFIX_LEVELS)])
    return index.select("table_id", "vector_id", F.posexplode(tags).alias("level", "prefix_key"))


def prefix_leaves(index: DataFrame, most: int = 32) -> DataFrame:
    """index with level and prefix_key: the shortest tagged prefix that at most that many entries share, else the longest."""
    out = index.withColumns({f"_p{k}": tagged_prefix(F.col("bucket_key"), k) for k in range(PREFIX_LEVELS)})
    level = F.lit(PREFIX_LEVELS - 1)
    for k in range(PREFIX_LEVELS - 2, -1, -1):
        counts = out.groupBy("table_id", f"_p{k}").agg((F.count("*") > most).alias(f"_c{k}"))
        out = out.join(counts, ["table_id", f"_p{k}"])
        level = F.when(~F.col(f"_c{k}"), F.lit(k)).otherwise(level)
    named = F.get(F.array(*[F.col(f"_p{k}") for k in range(PREFIX_LEVELS)]), level)
    return out.select(*index.columns, level.cast("int").alias("level"), named.alias("prefix_key"))


def prefix_candidates(leaves: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (query_id, neighbor_id) of different vectors whose entries ended under the same tagged prefix."""
    return search.candidates(leaves if queries is None else queries, leaves, bucket=["table_id", "prefix_key"])


def leaf_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("table_id", "leaf").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
