"""Sets of ids as pages of bits: a page holds 1024 ids as sixteen longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_BITS = 1024


def words(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """(page, word, bits): the ids as longs of 64 bits, or-ed together map-side."""
    i = F.col(id_col).cast("long")
    word = F.pmod(i, F.lit(PAGE_BITS)) / 64
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))
    return ids.filter(i.isNotNull()).groupBy(F.floor(i / PAGE_BITS).alias("page"), F.floor(word).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))


def members(bitset: DataFrame) -> DataFrame:
    """The ids of a set, ordered by nothing."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(1) == 1)
    return bitset.select("page", "word", F.explode(at).alias("bit")).select((F.col("page") * PAGE_BITS + F.col("word") * 64 + F.col("bit")).alias("id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("page", "word").agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.join(b.withColumnRenamed("bits", "_b"), ["page", "word"])
    return joined.select("page", "word", F.col("bits").bitwiseAND(F.col("_b")).alias("bits")).filter("bits <> 0")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    joined = a.join(b.withColumnRenamed("bits", "_b"), ["page", "word"], "left")
    return joined.select("page", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0)))).alias("bits")).filter("bits <> 0")


def flip(a: DataFrame) -> DataFrame:
    """The complement within the pages that exist; other pages stay empty."""
    grid = a.select("page").distinct().withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(PAGE_BITS // 64 - 1))))
    joined = grid.join(a, ["page", "word"], "left")
    return joined.select("page", "word", F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))).alias("bits")).filter("bits <> 0")


def contains(bitset: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """ids with present."""
    i = F.col(id_col).cast("long")
    probe = ids.withColumns({"page": F.floor(i / PAGE_BITS), "word": F.floor(F.pmod(i, F.lit(PAGE_BITS)) / 64).cast("int")})
    bit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), F.pmod(i, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    return probe.join(bitset, ["page", "word"], "left").select(*ids.columns, bit.alias("present"))


def page_counts(bitset: DataFrame) -> DataFrame:
    """(page, n) of pages with ids."""
    return bitset.groupBy("page").agg(F.sum(F.bit_count("bits")).alias("n"))
