"""Command line for spark-submit: make hash functions, build an index, search, stream, and measure.

    spark-submit simloom/cli.py generate --set family=pStable --set dim=64 --out functions
    spark-submit simloom/cli.py index --vectors vectors.txt --out index
    spark-submit simloom/cli.py search --vectors vectors.txt --out answers
    spark-submit simloom/cli.py stream --vectors folder --out state
    spark-submit simloom/cli.py accuracy --vectors vectors.txt --queries 50 [--unindexed]
    spark-submit simloom/cli.py write | read | latency --vectors vectors.txt
    spark-submit simloom/cli.py parallel --vectors vectors.txt --threads 10
    spark-submit simloom/cli.py storage --vectors vectors.txt --out folder
"""

from __future__ import annotations

import argparse
import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.config import Config
from simloom.functions import vectors
from simloom.operators import evaluate, index, search
from simloom.operators.families import make_family, save_family
from simloom.sources import text
from simloom.streaming import online


def load(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """Dense vectors from Parquet (vector_id, values) or from text files of either form."""
    if path.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(path)
        values = F.col("values").cast("array<double>")
        return rows.select("vector_id", (vectors.normalize(values) if config.normalize else values).alias("values"))
    rows = text.read_vectors(spark, path, normalize=config.normalize)
    return rows.select("vector_id", vectors.to_dense(F.col("size"), F.col("indices"), F.col("values")).alias("values"))


def timed(action) -> float:
    began = time.time()
    action()
    return time.time() - began


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def some(v: DataFrame, n: int) -> DataFrame:
    """n vectors, those of the smallest hashes of ids."""
    return v.orderBy(F.xxhash64("vector_id"), "vector_id").limit(n)


def accuracy(v: DataFrame, config: Config, family, n: int, unindexed: bool = False) -> dict:
    """Ratio, recall, efficiency and percentiles of n queries; unindexed ones are not in the index that they are held against."""
    queries = some(v, n)
    if unindexed:
        v = v.join(queries.select("vector_id"), "vector_id", "left_anti")
    i = index.build_index(v, family)
    pairs = search.candidates(index.build_index(queries, family), i)
    found = search.top_k(search.verify(pairs, v, queries=queries), config.top_k)
    exact = search.exact_knn(queries, v, config.top_k)
    ratios = evaluate.approximation_ratio(found, exact)
    effort = evaluate.efficiency(pairs, queries.select(F.col("vector_id").alias("query_id")), config.top_k)
    return {
        "mean_ratio": evaluate.mean_ratio(ratios).first()["mean_ratio"],
        "ratio_percentiles": {r.share: r.value for r in evaluate.percentile_summary(ratios, "ratio").collect()},
        "recall": evaluate.recall(found, exact).agg(F.avg("recall")).first()[0],
        "over_hits": effort.filter("over_hit").count(),
        "efficiency": effort.agg(F.avg("efficiency")).first()[0],
    }


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    config = Config.from_mapping(dict(s.split("=", 1) for s in args.set))
    family = make_family(config, spark)
    if args.mode == "generate":
        save_family(spark, family, args.out)
        return {"functions": len(family.lines())}
    if args.mode == "stream":
        state = online.OnlineIndex(spark, family, args.out, config.threshold, config.top_k, config.order, config.merge_threshold)
        stream = online.vector_stream(spark, args.vectors, vector_type="array<double>", vector_id="vector_id", values="values")
        trigger = {"processingTime": f"{config.batching_ms} milliseconds"} if config.batching_ms else {"availableNow": True}
        state.start(stream, f"{args.out}/checkpoint", **trigger).awaitTermination(args.timeout)
        return {"answers": state.results().count()}
    v = load(spark, args.vectors, config)
    if args.mode == "index":
        index.write_index(index.build_index(v, family), args.out)
        return {"vectors": v.count()}
    if args.mode == "search":
        search.lsh_search(v, index.build_index(v, family), config.top_k, config.threshold, config.order).write.mode("overwrite").parquet(args.out)
        return {"answers": spark.read.parquet(args.out).count()}
    if args.mode == "accuracy":
        return accuracy(v, config, family, args.queries, args.unindexed)
    n, i = v.count(), index.build_index(v, family)
    if args.mode in ("latency", "parallel"):
        return lookups(v, i, config, family, args.queries, args.threads if args.mode == "parallel" else 1)
    if args.mode == "storage":
        wrote = timed(lambda: index.write_index(i, args.out))
        read = timed(lambda: noop(spark.read.parquet(args.out)))
        again = timed(lambda: index.write_index(i, args.out))
        return {"vectors": n, "write_seconds": wrote, "read_seconds": read, "rewrite_seconds": again, "write_average": wrote / max(1, n)}
    seconds = timed(lambda: noop(i if args.mode == "write" else search.candidates(i, i)))
    return {"vectors": n, "seconds": seconds, "per_second": n / seconds}


def lookups(v: DataFrame, i: DataFrame, config: Config, family, n: int, threads: int) -> dict:
    """Times of n searches of one vector each, so many at once: every search is a job of its own, which the scheduler shares out."""
    ids = [r.vector_id for r in some(v, n).select("vector_id").collect()]

    def search_one(who) -> float:
        query = v.filter(F.col("vector_id") == who)
        return timed(lambda: noop(search.lsh_search(v, i, config.top_k, config.threshold, config.order, query, index.build_index(query, family))))

    began = time.time()
    with ThreadPoolExecutor(threads) as pool:
        took = list(pool.map(search_one, ids))
    seconds = time.time() - began
    return {"queries": len(took), "threads": threads, "average": sum(took) / max(1, len(took)), "max": max(took, default=0), "min": min(took, default=0), "per_second": len(took) / seconds}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=["generate", "index", "search", "stream", "accuracy", "write", "read", "latency", "parallel", "storage"])
    p.add_argument("--vectors")
    p.add_argument("--out")
    p.add_argument("--queries", type=int, default=50)
    p.add_argument("--threads", type=int, default=10)
    p.add_argument("--unindexed", action="store_true")
    p.add_argument("--timeout", type=int, default=None)
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    args = p.parse_args(argv)
    if args.mode != "generate" and not args.vectors:
        p.error("--vectors is needed")
    if args.mode in ("generate", "index", "search", "stream", "storage") and not args.out:
        p.error("--out is needed")
    return args


def main() -> None:
    spark = SparkSession.builder.appName("simloom").getOrCreate()
    print(json.dumps(run(spark, parse())))


if __name__ == "__main__":
    main()
