"""Streams in which every vector is searched first and inserted then.

Micro-batches are answered against what is stored (static and delta tables, as Parquet) and against earlier vectors of the
same batch. Every batch writes to folders named by its number, so a batch that runs again after a failure replaces what it
wrote before. Stored rows keep the number of their own batch, through merges too, and a batch reads those of earlier batches
alone; so a batch that runs again, before or after a merge, finds what it found at first.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simloom.operators import search
from simloom.operators.families import HashFamily
from simloom.sources import shared

VECTOR = T.StructType([T.StructField("vector_id", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
INDEX = T.StructType([T.StructField("table_id", T.IntegerType()), T.StructField("bucket_key", T.IntegerType()), T.StructField("vector_id", T.LongType())])


@dataclass
class OnlineIndex:
    """The state of a search-then-insert stream under a folder that all executors share."""

    spark: SparkSession
    family: HashFamily
    root: str
    threshold: float = 0.0
    top_k: int | None = None
    order: str = "similarity"
    merge_threshold: int = 1000

    def _read(self, kinds: tuple[str, ...], schema: T.StructType, before: int | None = None) -> DataFrame:
        """Stored rows, with their batch, of batches before one."""
        schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        paths = [p for kind in kinds for p in self._paths(kind)]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _paths(self, kind: str) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().toString() for s in fs.listStatus(fs_path)) if fs.exists(fs_path) else []

    def _write(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        """Write a batch's rows and read them back."""
        path = f"{self.root}/{kind}/{batch:012d}"
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).drop("batch")

    def vectors(self, before: int | None = None) -> DataFrame:
        """Stored vectors; one that a merge has copied and not yet removed is there once."""
        return self._read(("static_vectors", "vectors"), VECTOR, before).distinct().drop("batch")

    def index(self, before: int | None = None) -> DataFrame:
        return self._read(("static", "delta"), INDEX, before).drop("batch").distinct()

    def results(self) -> DataFrame:
        schema = "query_id long, neighbor_id long, similarity double"
        paths = self._paths("results")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def process(self, batch_df: DataFrame, batch: int) -> None:
        """Answer a micro-batch of (vector_id, values), then insert it; for foreachBatch."""
        fresh = self._write(batch_df.select("vector_id", F.col("values").cast("array<double>").alias("values")), "vectors", batch)
        keys = self._write(self.family.exploded(fresh), "delta", batch)
        stored, known = (self._read(kinds, schema, batch).drop("batch") for kinds, schema in ((("static", "delta"), INDEX), (("static_vectors", "vectors"), VECTOR)))
        before = search.scored(known, stored, self.threshold, queries=fresh, query_index=keys)
        scored = before.unionByName(search.scored(fresh, keys, self.threshold, earlier_only=True)).distinct()  # stored rows may be there twice
        if self.top_k:
            scored = search.top_k(scored, self.top_k, self.order).drop("rank")
        scored.write.mode("overwrite").parquet(f"{self.root}/results/{batch:012d}")
        self.maybe_merge(batch)

    def delta_size(self) -> int:
        """Vectors in the delta tables: every one has a row in the first table; the count is pushed to the scan."""
        return self._read(("delta",), INDEX).filter("table_id = 0").count()

    def maybe_merge(self, batch: int) -> bool:
        """Rewrite static and delta tables as one static table once the delta holds merge_threshold vectors, and vectors as one table.

        A new table has a name of its own and is written first; the old files go only after it is whole. If a merge is cut
        short, the next one finishes it: being in two tables changes no answer.
        """
        if self.delta_size() < self.merge_threshold:
            return False
        index = self._read(("static", "delta"), INDEX).groupBy(*INDEX.names).agg(F.min("batch").alias("batch"))
        ranged = index.repartitionByRange("table_id", "bucket_key").sortWithinPartitions("table_id", "bucket_key", "vector_id")
        self._replace(ranged, "static", ("static", "delta"), batch)
        self._replace(self._read(("static_vectors", "vectors"), VECTOR).distinct(), "static_vectors", ("static_vectors", "vectors"), batch)
        return True

    def _replace(self, df: DataFrame, kind: str, kinds: tuple[str, ...], batch: int) -> None:
        old = [p for k in kinds for p in self._paths(k)]
        df.write.parquet(f"{self.root}/{kind}/{batch:012d}-{uuid.uuid4().hex}")
        for path in old:
            shared.discard(self.spark, path)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run over a stream of (vector_id, values)."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def vector_stream(spark: SparkSession, path: str, files_per_batch: int = 1, vector_id: str = "vector_id", values: str = "values", vector_type: str = "array<float>") -> DataFrame:
    """A stream of vectors from Parquet files, paced by files a batch."""
    schema = f"{vector_id} long, {values} {vector_type}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).select(F.col(vector_id).alias("vector_id"), F.col(values).cast("array<double>").alias("values"))


def generation(seq, capacity: int, workers: int):
    """Which of the ring's workers takes the vector with this running number: the next one each time one is full."""
    return F.pmod(F.floor(seq / capacity), F.lit(workers)).cast("int")


def in_window(worker, lower: int, upper: int):
    """Whether a worker is in the update window; a window whose upper end is smaller wraps around, one with equal ends is one worker."""
    return (worker >= lower) & (worker <= upper) if lower <= upper else (worker >= lower) | (worker <= upper)


def owned(bucket_key, vector_id, window: int):
    """Whether a bucket's update is this vector's own share of a window of workers."""
    return F.pmod(bucket_key.cast("long"), F.lit(window)) == F.pmod(vector_id.cast("long"), F.lit(window))


def live_generations(df: DataFrame, seq: str, capacity: int, workers: int) -> DataFrame:
    """df with generation, without rows whose worker has since begun a later round of the ring."""
    round_no = F.floor(F.col(seq) / (capacity * workers))
    worker = generation(F.col(seq), capacity, workers)
    marked = df.withColumns({"generation": worker, "_round": round_no})
    newest = marked.groupBy("generation").agg(F.max("_round").alias("_last"))
    return marked.join(newest, "generation").filter("_round = _last").drop("_round", "_last")


def latency_windows(events: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, largest, smallest and mean of a value by event-time windows; works on streams and tables."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(
        F.count("*").alias("n"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.avg(value).alias("avg_value")
    )


def sliding_windows(events: DataFrame, time: str, value: str, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """As latency_windows, by windows that overlap."""
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("max_value"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of each run of a key's events with no longer pause than the gap."""
    found = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def insert_allocated(index: DataFrame, fresh: DataFrame, tables) -> DataFrame:
    """index with those rows of fresh whose tables this worker has; rows that it holds already come once."""
    return index.unionByName(fresh.filter(F.col("table_id").isin(list(tables))).select(*index.columns)).distinct()


def progress(query) -> list[dict]:
    """Rows and rows a second of each batch that a query reports."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "per_second": p["processedRowsPerSecond"]} for p in map(lambda x: json.loads(x.json), query.recentProgress)]
