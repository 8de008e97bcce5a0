"""Candidates from buckets, exact verification, and choosing neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import similarity
from simloom.operators import blocks
from simloom.sources import shared

#: A hot bucket is split by salts so that each part has at most about so many rows.
BUCKET_ROWS = 2000
#: Bytes of query vectors that one pass of exact search broadcasts at most.
PASS_BYTES = 8 << 20
#: Bytes of scores that a task of exact search holds at once.
SCORE_BYTES = 32 << 20
BUCKET = ["table_id", "bucket_key"]


def candidates(
    queries: DataFrame, index: DataFrame, keep_self: bool = False, earlier_only: bool = False, bucket_rows: int = BUCKET_ROWS, bucket: list[str] | None = None,
) -> DataFrame:
    """Distinct (query_id, neighbor_id) that share a bucket of some table.

    queries and index are (table_id, bucket_key, vector_id), or have other bucket columns. Index rows of crowded buckets are dealt to salts by a hash of the
    id, and query rows go to every salt of their bucket, so that no task meets a whole hot bucket; the number of salts comes
    from grouped counts. earlier_only keeps neighbours with smaller ids, the meaning of search-then-insert.
    """
    bucket = bucket or BUCKET
    counts = index.groupBy(*bucket).agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("salts"))
    n = index.join(counts, bucket).select(*bucket, F.pmod(F.xxhash64("vector_id"), "salts").cast("int").alias("salt"), F.col("vector_id").alias("neighbor_id"))
    q = queries.join(counts, bucket).select(*bucket, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("vector_id").alias("query_id"))
    pairs = q.join(n, [*bucket, "salt"]).select("query_id", "neighbor_id")
    if earlier_only:
        pairs = pairs.filter("neighbor_id < query_id")
    elif not keep_self:
        pairs = pairs.filter("neighbor_id <> query_id")
    return pairs.distinct()


def verify(pairs: DataFrame, vectors: DataFrame, threshold: float | None = None, vector_id: str = "vector_id", values: str = "values", queries: DataFrame | None = None) -> DataFrame:
    """pairs with similarity, the exact inner product, and at least threshold if one is given."""
    q = (queries if queries is not None else vectors).select(F.col(vector_id).alias("query_id"), F.col(values).alias("_q"))
    n = vectors.select(F.col(vector_id).alias("neighbor_id"), F.col(values).alias("_n"))
    out = pairs.join(q, "query_id").join(n, "neighbor_id").select("query_id", "neighbor_id", similarity.dot(F.col("_q"), F.col("_n")).alias("similarity"))
    return out if threshold is None else out.filter(similarity.at_least(F.col("similarity"), threshold))


def top_k(scored: DataFrame, k: int, order: str = "similarity") -> DataFrame:
    """The k first neighbours of each query with their rank: by falling similarity (ties to smaller ids), or by rising id."""
    by = [F.desc("similarity"), F.asc("neighbor_id")] if order == "similarity" else [F.asc("neighbor_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def scored(
    vectors: DataFrame, index: DataFrame, threshold: float | None = None, k: int | None = None, order: str = "similarity", earlier_only: bool = False,
    queries: DataFrame | None = None, query_index: DataFrame | None = None, vector_id: str = "vector_id", values: str = "values",
) -> DataFrame:
    """candidates, verified: (query_id, neighbor_id, similarity) of vectors that share a bucket, with at least the threshold.

    Pairs are never shuffled: vectors are packed into blocks with their buckets, and what two blocks have in common is found
    where they meet. With k, the k first neighbours are there, and others may be; top_k picks them.
    """
    stored = blocks.keyed(vectors, index, vector_id, values)
    own = queries is None and query_index is None
    asking = stored if own else blocks.keyed(vectors if queries is None else queries, index if query_index is None else query_index, vector_id, values)
    return blocks.search(asking, stored, threshold, k, order, earlier_only)


def lsh_search(vectors: DataFrame, index: DataFrame, k: int, threshold: float | None, order: str = "similarity", queries: DataFrame | None = None, query_index: DataFrame | None = None) -> DataFrame:
    """Approximate search: bucket candidates, exact verification, threshold, and the k first of each query."""
    return top_k(scored(vectors, index, threshold, k, order, queries=queries, query_index=query_index), k, order)


def search_then_insert(vectors: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """Every vector against those that came before it (smaller ids), as a stream that searches first and inserts then answers."""
    return scored(vectors, index, threshold, earlier_only=True)


def exact_knn(
    queries: DataFrame, vectors: DataFrame, k: int | None, threshold: float | None = None,
    vector_id: str = "vector_id", values: str = "values", exclude_self: bool = True, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Exact k nearest by inner product: (query_id, neighbor_id, similarity, rank), ties to smaller ids.

    With a threshold only neighbours of at least that similarity count; with k None all of these come, without ranks.

    Queries are a stated set; they are carried to the partitions of vectors in passes of bounded size, each partition keeps its
    k best for each query by matrix products, and a window picks from those. Vectors are neither shuffled nor crossed.
    """
    sized = queries.select(F.col(vector_id).alias("query_id"), F.col(values).cast("array<double>").alias("q")).filter("q IS NOT NULL")
    n, width = sized.agg(F.count("*"), F.max(F.size("q"))).first()
    passes = max(1, -(-(n * (width or 1) * 8) // pass_bytes))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    rows = vectors.select(F.col(vector_id).cast("long").alias("neighbor_id"), F.col(values).cast("array<double>").alias("v")).filter(F.size("v") == (width or 0))
    out = None
    for turn in range(passes):
        batch = sized.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn).filter(F.size("q") == (width or 0)).collect()
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in batch], np.int64), np.array([r.q for r in batch], float).reshape(len(batch), width or 0)))
        part = rows.mapInArrow(_scan(sent, k, threshold, exclude_self), "query_id long, neighbor_id long, similarity double")
        if k is not None:
            part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(sent, k, threshold, exclude_self):
    if k is None and threshold is None:
        raise ValueError("either k or a threshold bounds the result")

    def rows(query_ids, scores, neighbors):
        there = scores > -np.inf
        found = pd.DataFrame({"query_id": np.broadcast_to(query_ids[:, None], there.shape)[there], "neighbor_id": neighbors[there], "similarity": scores[there]})
        return pa.RecordBatch.from_pandas(found, preserve_index=False)

    def run(batches):
        query_ids, q = sent.value
        best_s, best_n = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        step = max(1, SCORE_BYTES // (8 * max(1, len(q))))
        for batch in (whole.slice(lo, step) for whole in batches for lo in range(0, len(whole), step)):
            if not len(q):
                continue
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            s = q @ x.T
            if exclude_self:
                s[query_ids[:, None] == ids[None, :]] = -np.inf
            if threshold is not None:
                s[s < threshold] = -np.inf
            if k is None:
                yield rows(query_ids, s, np.broadcast_to(ids, s.shape))
                continue
            s, n = np.concatenate([best_s, s], 1), np.concatenate([best_n, np.broadcast_to(ids, s.shape)], 1)
            at = np.lexsort((n, -s), axis=1)[:, :k]
            best_s, best_n = np.take_along_axis(s, at, 1), np.take_along_axis(n, at, 1)
        if (best_s > -np.inf).any():
            yield rows(query_ids, best_s, best_n)

    return run


def postings(sparse: DataFrame, vector_id: str = "vector_id") -> DataFrame:
    """The inverted index of sparse vectors: (dimension, vector_id, value), one row a non-zero."""
    return sparse.select(F.explode(F.arrays_zip("indices", "values")).alias("e"), F.col(vector_id).alias("vector_id")).select(
        F.col("e.indices").alias("dimension"), "vector_id", F.col("e.values").alias("value")
    )


def hot_keys(rows: DataFrame, key: str, part_rows: int = BUCKET_ROWS, share: int = 1000) -> DataFrame:
    """(key, salts) of keys on more than one of share rows (and more than part_rows): at most share of them, so they may be broadcast."""
    counts = shared.cut(rows.groupBy(key).agg(F.count("*").alias("_n")))
    bound = max(part_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // share)
    return counts.filter(F.col("_n") > bound).select(key, F.ceil(F.col("_n") / bound).cast("int").alias("_salts"))


def salted_join(rows: DataFrame, table: DataFrame, key: str, part_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows joined with table (one row a key) where some keys are on very many rows: those are dealt by salts, table's rows to each."""
    hot = F.broadcast(shared.cut(hot_keys(rows, key, part_rows)))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), salts).cast("int")).drop("_salts")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def sparse_join(sparse: DataFrame, threshold: float, queries=None) -> DataFrame:
    """Pairs of sparse vectors that share a dimension, by inner product, at least threshold.

    Without queries (a condition on vector_id) each pair comes once, query_id < neighbor_id; with it, the vectors that it
    names are held against all others. Dimensions are salted like hot buckets; products are summed map-side before the
    shuffle by pair.
    """
    post = postings(sparse)
    asking = post if queries is None else post.filter(queries)
    counts = post.groupBy("dimension").agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("salts"))
    n = post.join(counts, "dimension").select("dimension", F.pmod(F.xxhash64("vector_id"), "salts").cast("int").alias("salt"), F.col("vector_id").alias("neighbor_id"), F.col("value").alias("b"))
    q = asking.join(counts, "dimension").select("dimension", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("vector_id").alias("query_id"), F.col("value").alias("a"))
    pairs = q.join(n, ["dimension", "salt"]).filter("query_id < neighbor_id" if queries is None else "query_id <> neighbor_id")
    return pairs.groupBy("query_id", "neighbor_id").agg(F.sum(F.col("a") * F.col("b")).alias("similarity")).filter(F.col("similarity") >= threshold)
