"""How good and how fast a search was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.similarity import angular_distance
from simloom.sources import shared


def efficiency(pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For each query: candidates, efficiency (candidates over k, cut down; 0 under k), over_hit (k candidates at least)."""
    counts = pairs.groupBy("query_id").agg(F.count("*").alias("n"))
    found = queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"))
    ratio = F.when(F.col("candidates") >= k, F.floor(F.col("candidates") / k)).otherwise(F.lit(0)).cast("long")
    return found.select("query_id", "candidates", ratio.alias("efficiency"), (F.col("candidates") >= k).alias("over_hit"))


def approximation_ratio(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query of exact: the mean over ranks of the angle found over the true angle, and how many ranks had none.

    A missing neighbour counts as a right angle; ranks where the ratio is no number are left out of the mean.
    """
    a = approx.select("query_id", "rank", F.col("similarity").alias("_a"))
    e = exact.select("query_id", "rank", F.col("similarity").alias("_e"))
    both = e.join(a, ["query_id", "rank"], "left")
    ratio = F.try_divide(angular_distance(F.col("_a")), angular_distance(F.col("_e")))
    ratio = F.when(F.isnan(ratio), None).otherwise(ratio)
    return both.groupBy("query_id").agg(F.avg(ratio).alias("ratio"), F.count_if(ratio.isNull()).alias("undefined"))


def mean_ratio(ratios: DataFrame) -> DataFrame:
    return ratios.agg(F.avg("ratio").alias("mean_ratio"), F.count("ratio").alias("queries"))


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query of exact the share of its neighbours that approx has."""
    hits = exact.select("query_id", "neighbor_id").join(approx.select("query_id", "neighbor_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "neighbor_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def percentile_summary(df: DataFrame, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(share, value): of the sorted values the one at place int(n * share).

    Equal values are counted first. Counts are dealt by ranges of the value and added up within each range; the totals of the
    ranges, one row a partition, say where each range begins. No task sees more than its range.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = shared.cut(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.sum("n").alias("_sum"))
    starts = starts.select("_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))
    within = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_upto", F.sum("n").over(within)).join(F.broadcast(starts), "_part").withColumn("_upto", F.col("_start") + F.col("_upto"))
    placed = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    place = F.floor(F.col("_total") * F.col("share")).cast("long")
    return placed.filter((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("n"))).select("share", "value")


def summary(df: DataFrame, value: str | Column, by: list[str] | None = None) -> DataFrame:
    """n, max, min and mean of a latency column, over all rows or by groups."""
    v = F.col(value) if isinstance(value, str) else value
    aggregates = [F.count(v).alias("n"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.avg(v).alias("avg_value")]
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def client_summary(df: DataFrame, client: str, value: str) -> DataFrame:
    """Clients, and the largest, smallest and mean of their own mean latencies."""
    each = df.groupBy(client).agg(F.avg(value).alias("own"))
    return each.agg(F.count("own").alias("clients"), F.max("own").alias("max_value"), F.min("own").alias("min_value"), F.avg("own").alias("avg_value"))


def throughput(df: DataFrame, time: str) -> DataFrame:
    """Rows, seconds between the first and the last, and rows a second (null without a duration)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    seconds = (F.max(at) - F.min(at)) / 1e6
    return df.agg(F.count("*").alias("n"), seconds.alias("seconds")).withColumn("per_second", F.try_divide(F.col("n"), "seconds"))
