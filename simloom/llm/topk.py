"""Exact top-k inner-product search by block-at-a-time pruning (op1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm import common

SCALE = 1024
#: Rows of one block: consecutive ids, bounded together and scored together.
BLOCK_ROWS = 128
#: Rows of one partition of the scored table, about, and queries that one pass carries at most.
PART_ROWS, PASS_QUERIES = 8192, 4096
#: Rows, about, whose k-th scores are shared with all partitions before the search of the whole table.
SEED_ROWS = 8192


class Block:
    """A range of rows: its forward index (rows x terms) and the extremes of every term."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.most, self.least = weights.max(0), weights.min(0)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without rounding: in doubles while every sum stays under 2**53, then in long or unbounded integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if top < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def search_blocks(queries: np.ndarray, query_ids: np.ndarray, blocks: list[Block], k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (score desc, id asc) of all blocks for each query, never its own id: (scores, ids, blocks scored).

    A query's bound on a block is the sum over terms of the query weight times the block's maximum (for negative weights, its
    minimum). Each query takes its blocks by falling bound; once the next bound is below its k-th score, or below its floor (a
    k-th score that is known already), it is done. Missing places hold the lowest score and id -1.
    """
    n = len(queries)
    lowest = np.iinfo(np.int64).min
    floors = np.full(n, lowest) if floors is None else floors
    scores, ids = np.full((n, k), lowest), np.full((n, k), -1, np.int64)
    if not blocks or not n:
        return scores, ids, 0
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    most, least = np.stack([b.most for b in blocks]), np.stack([b.least for b in blocks])
    bounds = _exact(up, most) + _exact(down, least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive, scored = np.arange(n), 0
    for turn in range(len(blocks)):
        block_at = order[alive, turn]
        bound = bounds[alive, block_at]
        keep = ((ids[alive, k - 1] < 0) | (bound >= scores[alive, k - 1])) & (bound >= floors[alive])
        alive, block_at = alive[keep], block_at[keep]
        if not len(alive):
            break
        for b in np.unique(block_at).tolist():
            q, block = alive[block_at == b], blocks[b]
            scored += len(q)
            got = _exact(queries[q], block.weights).astype(np.int64)
            found = np.broadcast_to(block.ids, got.shape)
            own = found == query_ids[q][:, None]
            all_scores = np.concatenate([scores[q], np.where(own, lowest, got)], 1)
            all_ids = np.concatenate([ids[q], np.where(own, -1, found)], 1)
            best = _order(all_scores, all_ids)
            rows = np.arange(len(q))[:, None]
            scores[q], ids[q] = all_scores[rows, best[:, :k]], all_ids[rows, best[:, :k]]
    return scores, ids, scored


def _order(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Columns by score desc, id asc, with missing places last."""
    by_id = np.argsort(np.where(ids < 0, np.iinfo(np.int64).max, ids), axis=1, kind="stable")
    score = np.take_along_axis(scores, by_id, 1)
    gone = np.take_along_axis(ids, by_id, 1) < 0
    by_score = np.argsort(np.where(gone, np.iinfo(np.int64).max, -1 - score), axis=1, kind="stable")
    return np.take_along_axis(by_id, by_score, 1)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components floor(scale * x); rows with a null id or vector, or a null or non-finite component, go."""
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    top = float(2**62)
    return rows.select("vec_id", F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-top)), F.lit(top))), F.lit(-(2**62))), F.lit(2**62)).cast("long")).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; a shorter vector counts as having zeros, and so does what lies beyond width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    wide = np.zeros(inside.shape, np.int64)
    wide[inside] = flat
    keep = min(width, wide.shape[1])
    out[:, :keep] = wide[:, :keep]
    return out


def top_k(
    vectors: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS, pass_queries: int = PASS_QUERIES,
) -> DataFrame:
    """The k rows with the largest integer inner product for each row whose id is divisible by query_every.

    Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id; fewer rows where there are fewer. Vectors
    that are null or hold null or non-finite components take no part; an empty table gives an empty one. Rows that repeat an
    id are candidates each, but ask once (the first by components), and find none of their own id. Vectors of unequal length
    are filled up with zeros.

    Components beyond 2**62 and scores beyond the range of long are held at its ends.

    The quantized table is dealt by ranges of ids and kept in the shared folder. Every pass carries at most about
    pass_queries queries (a bounded number of rows of one vector each) to all partitions. First a part of about SEED_ROWS rows
    is searched: its k-th scores are floors for all partitions. Each partition prunes block by block and hands on at most k
    rows a query, none under the floor, and a window picks the k best of those.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, id_col, vector_col)
    n, = rows.agg(F.count("*")).first()
    dealt = common.cut(rows.repartitionByRange(max(1, -(-n // part_rows)), "vec_id").sortWithinPartitions("vec_id"))
    asking = dealt.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    passes, every = max(1, -(-asking.count() // pass_queries)), n // SEED_ROWS
    seed = dealt.filter(F.pmod(F.xxhash64("vec_id", F.lit("seed")), F.lit(every)) == 0) if every > 1 else None
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    search = lambda table, sent: table.mapInArrow(_searcher(sent, k, block_rows), "query_id long, vec_id long, score long").withColumn("rank", best).filter(F.col("rank") <= k)
    results = []
    for turn in range(passes):
        batch = asking.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn).orderBy("vec_id").collect()
        query_ids = np.array([r.vec_id for r in batch], np.int64)
        width = max([len(r.q) for r in batch], default=0)
        queries = np.zeros((len(batch), width), np.int64)
        for at, r in enumerate(batch):
            queries[at, : len(r.q)] = r.q
        floors = np.full(len(batch), np.iinfo(np.int64).min)
        if seed is not None:
            known = {r.query_id: r.score for r in search(seed, spark.sparkContext.broadcast((query_ids, queries, floors))).filter(F.col("rank") == k).collect()}
            floors = np.array([known.get(x, np.iinfo(np.int64).min) for x in query_ids.tolist()], np.int64)
        part = search(dealt, spark.sparkContext.broadcast((query_ids, queries, floors))).select("query_id", "rank", "vec_id", "score")
        if passes > 4:
            path = common.scratch_path(spark, "topk")
            part.write.parquet(path)
            part = spark.read.parquet(path)
        results.append(part)
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def _searcher(sent, k, block_rows):
    def run(batches):
        query_ids, queries, floors = sent.value
        best_scores, best_ids, held, held_ids = None, None, [], []

        def flush(ids, rows):
            nonlocal best_scores, best_ids
            blocks = [Block(ids[a : a + block_rows], rows[a : a + block_rows]) for a in range(0, len(ids), block_rows)]
            known = floors if best_scores is None else np.maximum(floors, best_scores[:, k - 1])
            scores, found, _ = search_blocks(queries, query_ids, blocks, k, known)
            if best_scores is not None:
                scores, found = np.concatenate([best_scores, scores], 1), np.concatenate([best_ids, found], 1)
                at = _order(scores, found)[:, :k]
                scores, found = np.take_along_axis(scores, at, 1), np.take_along_axis(found, at, 1)
            best_scores, best_ids = scores, found

        for batch in batches:
            held_ids.append(batch.column(0).to_numpy())
            held.append(_matrix(batch.column(1), queries.shape[1]))
            if sum(map(len, held)) >= 64 * block_rows:
                flush(np.concatenate(held_ids), np.concatenate(held))
                held, held_ids = [], []
        if held:
            flush(np.concatenate(held_ids), np.concatenate(held))
        if best_scores is not None and len(query_ids):
            there = (best_ids >= 0) & (best_scores >= floors[:, None])
            out = pd.DataFrame({"query_id": np.broadcast_to(query_ids[:, None], there.shape)[there], "vec_id": best_ids[there], "score": best_scores[there]})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


#: DuckDB SQL of the query.
TOP_K_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(v) AS v FROM q WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM a JOIN q b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
