"""Vector files: listing, reading and writing both text forms, and spilled collections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions import hashing, vectors
from simloom.sources import shared


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file under a folder, or of the file itself."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def read_vectors(spark: SparkSession, path: str, strict: bool = True, normalize: bool = False) -> DataFrame:
    """(vector_id, size, indices, values) of the lines of text files in either form.

    A line of neither form, or whose vector is not valid, is an error when read if strict, else it is left out.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).filter(F.trim("value") != "")
    v = lines.select(vectors.parse(F.trim("value")).alias("v"))
    good = F.col("v").isNotNull() & F.coalesce(vectors.valid(F.col("v.size"), F.col("v.indices"), F.col("v.values")), F.lit(False))
    v = v.filter(F.assert_true(good, "not a vector line").isNull()) if strict else v.filter(good)
    values = vectors.normalize(F.col("v.values")) if normalize else F.col("v.values")
    return v.select("v.vector_id", "v.size", "v.indices", values.alias("values"))


def write_vectors(df: DataFrame, path: str, form: int = 1) -> None:
    shape = vectors.format_form_one if form == 1 else vectors.format_form_two
    df.select(shape(F.col("vector_id"), F.col("size"), F.col("indices"), F.col("values")).alias("value")).write.text(path)


def load_capped(df: DataFrame, cap: int, order: str = "vector_id") -> DataFrame:
    """The first cap vectors by id with new ids from 0 on; all of them where there are fewer."""
    few = df.orderBy(order).limit(cap)
    return number_rows(few.withColumnRenamed("vector_id", "_old"), "_old" if order == "vector_id" else order).drop("_old")


def number_rows(df: DataFrame, order: str | Column, name: str = "vector_id") -> DataFrame:
    """df with consecutive numbers from 0 in the given order.

    Rows are dealt by ranges and numbered within each; the counts of the ranges, one row a partition, give the offsets.
    """
    by = F.col(order) if isinstance(order, str) else order
    return running_total(df, [], [by], F.lit(1), name)


def running_total(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group that come before it in the given order.

    Rows are dealt by ranges of (group, order) and added up within each; the sums of each group in each range, few rows, give
    the offsets. No task holds more than a range, however many rows a group has.
    """
    ranged = shared.cut(df.repartitionByRange(*[F.col(c) for c in group], *order).withColumns({"_part": F.spark_partition_id(), "_value": value.cast("long")}))
    sums = ranged.groupBy("_part", *group).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = ranged.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = [F.col("r._part") == F.col("s._part"), *[F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group]]
    joined = added.alias("r").join(F.broadcast(starts).alias("s"), same)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns if c != name], (F.col("_start") + F.col("_within")).cast("long").alias(name))


def counted(rows: DataFrame, words: str, vector_id: str = "vector_id") -> DataFrame:
    """(vector_id, indices, values) of arrays of words: the different words of each row, and how often they are in it."""
    shared.bound_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_pylist(), batch.column(1).values
            each = [pc.value_counts(flat.slice(a, b - a)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = pa.array([0, *np.cumsum([len(x) for x in each]).tolist()], pa.int32())
            names, n = pa.concat_arrays([x.field(0) for x in each]), pa.concat_arrays([x.field(1) for x in each])
            lists = [pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, n.cast(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["vector_id", "indices", "values"])

    picked = rows.select(F.col(vector_id).cast("long").alias("vector_id"), words)
    return picked.mapInArrow(lambda batches: run(b for b in batches if len(b)), "vector_id long, indices array<string>, values array<double>")


def spill(df: DataFrame, path: str, key: str) -> None:
    """Append a generation of a collection to a folder, with a bloom filter on its key for the lookups that come."""
    df.write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


class SpilledCollection:
    """A keyed collection in memory whose rows move to disk once they are too many: one generation of files a spill.

    Sizes are rows. As in a store that checks its size where it is read, a lookup spills first if the threshold is reached.
    Files have bloom filters on the key, which the reader asks before it reads a row group.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, threshold: int):
        self.spark, self.root, self.key, self.threshold, self.generations, self.memory = spark, root, key, threshold, 0, None

    def put(self, rows: DataFrame) -> None:
        self.memory = rows if self.memory is None else self.memory.unionByName(rows)

    def maybe_spill(self) -> bool:
        """Write what is in memory as the newest generation and empty it, if it has reached the threshold."""
        if self.memory is None or self.memory.count() < self.threshold:
            return False
        spill(self.memory, f"{self.root}/generation={self.generations:06d}", self.key)
        self.generations, self.memory = self.generations + 1, None
        return True

    def lookup(self, values: list) -> DataFrame:
        """Rows of the given keys with age: 0 for those in memory, then 1 for the newest generation, and so on."""
        self.maybe_spill()
        if self.memory is None and not self.generations:
            raise ValueError("nothing was put into the collection")
        parts = [] if self.memory is None else [self.memory.filter(F.col(self.key).isin(values)).withColumn("age", F.lit(0))]
        newest = self.generations
        for k in range(self.generations):
            rows = self.spark.read.parquet(f"{self.root}/generation={k:06d}").filter(F.col(self.key).isin(values))
            parts.append(rows.withColumn("age", F.lit(newest - k)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def latest(self, values: list) -> DataFrame:
        """The newest row of each of the given keys."""
        found = self.lookup(values)
        rest = [c for c in found.columns if c not in (self.key, "age")]
        picked = found.groupBy(self.key).agg(F.min_by(F.struct(*rest), "age").alias("_v"))
        return picked.select(self.key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def synthetic(spark: SparkSession, n: int, dim: int, zero_share: float, seed: int = 42) -> DataFrame:
    """n sparse vectors of ones, each component zero with the given chance, from the integer scramble of its number."""
    grain = 1 << 20
    draw = lambda d: hashing.scramble(F.col("id") * dim + d + seed) % grain >= int(zero_share * grain)
    indices = F.filter(F.sequence(F.lit(0), F.lit(dim - 1)), draw)
    return spark.range(n).select(F.col("id").alias("vector_id"), F.lit(dim).alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
