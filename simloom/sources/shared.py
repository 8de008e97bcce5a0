"""The folder that all executors share, and tables kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch; Spark's own defaults would hold ten thousand long rows at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in a local session, a temporary one, which is then set.

    Executors on other machines see no temporary folder of the driver, so there an unset folder is an error.
    """
    context = spark.sparkContext
    set_here = context._jsc.sc().getCheckpointDir()
    if set_here.isDefined():
        return set_here.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="simloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, gather: bool = False) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder.

    gather shuffles a table that is far smaller than what its tasks have read into fewer, fuller files.
    """
    shared_dir(df.sparkSession)
    return (df.hint("rebalance") if gather else df).checkpoint()


def bound_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of the session's Arrow batches, unless it has bounds of its own."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
