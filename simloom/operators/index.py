"""Bucket indexes: statistics, layout, partitions and shards.

An index is a table (table_id, bucket_key, vector_id). Everything here works on that table alone; vectors stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions import hashing
from simloom.operators.families import AngleFamily, HashFamily
from simloom.sources import text


def build_index(vectors: DataFrame, family: HashFamily, vector_id: str = "vector_id", values: str = "values") -> DataFrame:
    return family.exploded(vectors, vector_id, values)


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store an index by table, clustered by bucket, with bloom filters on the vector id for point reads."""
    clustered = index.repartitionByRange("table_id", "bucket_key").sortWithinPartitions("table_id", "bucket_key", "vector_id")
    clustered.write.mode(mode).partitionBy("table_id").option("parquet.bloom.filter.enabled#vector_id", "true").parquet(path)


def bucket_counts(index: DataFrame) -> DataFrame:
    """(table_id, bucket_key, n)."""
    return index.groupBy("table_id", "bucket_key").agg(F.count("*").alias("n"))


def bucket_offsets(index: DataFrame) -> DataFrame:
    """bucket_counts with first_slot, the exclusive running total within the table in key order."""
    return text.running_total(bucket_counts(index), ["table_id"], [F.col("bucket_key")], F.col("n"), "first_slot")


def vector_slots(index: DataFrame) -> DataFrame:
    """index with slot, the place of each vector in its table by bucket and id; neither a table nor a bucket has to fit into a task."""
    rows = index.select("table_id", "bucket_key", "vector_id")
    return text.running_total(rows, ["table_id"], [F.col("bucket_key"), F.col("vector_id")], F.lit(1), "slot")


def hash_partition(value: Column, partitions: int) -> Column:
    """The residue of the value, never negative."""
    return F.pmod(value.cast("long"), F.lit(partitions).cast("long")).cast("int")


def key_bits(key: Column) -> Column:
    """The 32 bits of a key as an array of doubles, bit i at place i."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", hashing.unsigned32(key), i).bitwiseAND(1).cast("double"))


def locality_partition(key: Column, planes: AngleFamily, bits: int) -> Column:
    """A partition under 2**bits for a key: its bits, as a vector, are hashed again by a second angle family of dimension 32.

    Keys that share many bits tend to share a partition.
    """
    if planes.dim != 32 or not 0 < bits <= planes.chain:
        raise ValueError("the second family hashes 32 bits, to at least as many as asked for")
    return F.shiftright(hashing.unsigned32(planes.key_expression(key_bits(key), 0)), 32 - bits).cast("int")


def segment(key: Column, bucket_bits: int) -> Column:
    """The key's bits above the lowest bucket_bits."""
    return F.shiftright(hashing.unsigned32(key), bucket_bits).cast("int")


def shard_allocation(index: DataFrame, shards: int, tables: int) -> DataFrame:
    """(vector_id, shard_id, table_ids): which tables of a vector each shard is to look up, filled up with -1 to all tables."""
    placed = index.withColumn("shard_id", hash_partition(F.col("bucket_key"), shards))
    listed = placed.groupBy("vector_id", "shard_id").agg(F.array_sort(F.collect_list("table_id")).alias("found"))
    padded = F.concat("found", F.array_repeat(F.lit(-1), F.lit(tables) - F.size("found")))
    return listed.select("vector_id", "shard_id", padded.alias("table_ids"))
