"""What the operators of this subpackage share: input columns, text batches and scratch space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.sources.shared import cut, discard, scratch_path, shared_dir

__all__ = ["cut", "discard", "scratch_path", "shared_dir"]

#: Text bytes that a Python worker holds decoded at once; a single longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch; Spark's own defaults would hold ten thousand long texts at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows that the Parquet reader decodes at once; at its default, long texts make very large arrays.
READER_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches and reader batches of the session, unless it has bounds of its own."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096":
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under fixed names, so that no other column can clash."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    """Whether crc32 of the id as text, modulo modulus, equals remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def spans(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about limit each."""
    if not len(sizes):
        return []
    parts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def text_slices(batches, limit: int = SLICE_BYTES, column: int = 1):
    """(record batch slice, its texts) of about limit bytes each; null is an empty text, bad UTF-8 is replaced."""
    for batch in batches:
        data = batch.column(column).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
        for lo, hi in spans(sizes, limit):
            part = batch.slice(lo, hi - lo)
            yield part, [x.decode("utf-8", "replace") if x else "" for x in data.slice(lo, hi - lo).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, label of about limit labelled documents, chosen by a hash of the id among the rows that learn allows.

    Ids labelled both 0 and 1 are left out. At most about limit label rows, of two numbers each, are broadcast.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_max"))
    marks = marks.filter("label = _max").drop("_max")
    n = marks.count()
    grain = 1 << 30
    bound = grain if n <= limit else grain * limit // n
    chosen = lambda c: F.pmod(F.xxhash64(c, F.lit("labelled")), F.lit(grain)) < bound
    rows = id_text(docs, id_col, text_col).filter(chosen(F.col("doc_id")))
    return rows.join(F.broadcast(marks.filter(chosen(F.col("doc_id")))), "doc_id")


def filter_texts(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text keep takes: keep turns a list of texts into a sequence of booleans."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for part, texts in text_slices(batches, column=at):
            yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
