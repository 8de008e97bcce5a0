"""Blocks of rows that are held against one another where pairs of rows are too many to be shuffled.

A block is one row with an Arrow batch of rows in it. Groups of blocks meet groups of blocks; what pairs of rows come to is worked
out in the workers, and only what is found leaves them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.sources import shared

#: Rows and bytes of a block at most (a longer row is a block of its own).
ROWS, BYTES = 2048, 2 << 20
#: Blocks of a group that a task keeps, and tasks for each core that pairs of groups are dealt to at least.
KEPT, TASKS = 16, 3
#: Rows of one bucket pairing or score matrix that are looked at together.
SLICE = 512
#: Of all pairs of two blocks, the share up to which the buckets' pairs are listed one by one.
LISTED = 1 / 16


def packed(rows: DataFrame, bound: str, most_rows: int = ROWS, most_bytes: int = BYTES, falling: bool = False) -> DataFrame:
    """(block, n, low, high, data): rows as blocks, with the extremes of a number column, kept in the shared folder.

    falling sorts the rows of a block by that column, the highest first.
    """
    shared.bound_batches(rows.sparkSession)

    def run(batches):
        held, n, size = [], 0, 0

        def block():
            whole = _short(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            whole = whole.sort_by([(bound, "descending")]) if falling else whole
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(whole)
            at = whole.column(whole.schema.get_field_index(bound)).to_numpy(zero_copy_only=False).astype(float)
            return pa.RecordBatch.from_arrays([pa.array([len(whole)]), pa.array([at.min()]), pa.array([at.max()]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n", "low", "high", "data"])

        for batch in batches:
            step = max(1, len(batch) * most_bytes // max(1, 4 * batch.nbytes))
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                if held and (n + len(part) > most_rows or size + part.nbytes > most_bytes):
                    yield block()
                    held, n, size = [], 0, 0
                held.append(part)
                n, size = n + len(part), size + part.nbytes
        if held:
            yield block()

    return shared.cut(rows.mapInArrow(run, "n long, low double, high double, data binary").withColumn("block", F.monotonically_increasing_id()))


def met(left: DataFrame, right: DataFrame, where=None, most: int | None = None) -> DataFrame:
    """(n_block, n_data, q_block, q_data) of all pairs of blocks, or of those where a condition on n_low, n_high, q_low and q_high holds.

    Blocks of both sides are dealt to groups, and groups meet by an equi-join; each block is copied once for a group of the other
    side. A task keeps most blocks of right, about, and goes through left's: the pairs of a block of left come one after the other.
    """
    kept = max(1, -(-right.count() // (most or KEPT)))
    passes = max(1, -(-TASKS * left.sparkSession.sparkContext.defaultParallelism // kept))
    number = F.shiftright("block", 33) + F.col("block").bitwiseAND((1 << 33) - 1)
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def side(df, name, pass_no, group):
        named = df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("block", "low", "high", "data")], pass_no.alias("_pass"), group.alias("_group"))
        return named.repartition(4 * passes * kept, "_pass", "_group")

    n = side(left, "n", F.pmod(number, F.lit(passes)).cast("int"), all_of(kept))
    q = side(right, "q", all_of(passes), F.pmod(number, F.lit(kept)).cast("int"))
    out = n.hint("merge").join(q, ["_pass", "_group"])
    return (out if where is None else out.filter(where)).select("n_block", "n_data", "q_block", "q_data")


def unpacked(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def keyed(vectors: DataFrame, index: DataFrame, vector_id: str, values: str) -> DataFrame:
    """Blocks of vectors (vector_id, x, codes) with the buckets that an index names for their id; others have no part.

    Vectors with a null component have no inner product and are left out.
    """
    code = F.shiftleft(F.col("table_id").cast("long"), 32) + F.col("bucket_key").cast("long").bitwiseAND(0xFFFFFFFF)
    codes = index.groupBy("vector_id").agg(F.array_sort(F.collect_set(code)).alias("codes"))
    x = vectors.select(F.col(vector_id).cast("long").alias("vector_id"), F.col(values).cast("array<double>").alias("x"))
    rows = x.filter(~F.exists("x", lambda c: c.isNull())).join(codes, "vector_id").select("vector_id", "x", "codes")
    return packed(rows.coalesce(max(1, -(-vectors.count() // ROWS))), "vector_id")


def _short(batch: pa.RecordBatch) -> pa.RecordBatch:
    """batch with arrays of doubles as floats where that changes no value."""
    for k, column in enumerate(batch.columns):
        if column.type == pa.list_(pa.float64()):
            x = column.flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            if np.array_equal(short.astype(float), x, equal_nan=True):
                batch = batch.set_column(k, batch.schema.names[k], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))]), pa.int32()), pa.array(short)))
    return batch


class Vectors:
    """A block of vectors with their buckets, unpacked."""

    def __init__(self, data):
        batch = unpacked(data)
        self.ids = batch.column(0).to_numpy()
        x, codes = batch.column(1), batch.column(2)
        self.widths = np.diff(x.offsets.to_numpy())
        self.dim = int(self.widths.max(initial=0))
        self.x = np.zeros((len(self.ids), self.dim))
        self.x[np.arange(self.dim) < self.widths[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            self.length = float(np.sqrt((self.x * self.x).sum(1)).max(initial=0))
        n = np.diff(codes.offsets.to_numpy())
        flat, owner = codes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
        self.codes, self.first = flat, np.concatenate([[0], np.cumsum(n)])
        order = np.argsort(flat, kind="stable")
        self.sorted, self.owner = flat[order], owner[order]
        self.grid = flat.reshape(len(n), -1) if len(n) and (n == n[0]).all() else None
        if self.grid is not None:
            tables = self.grid >> 32
            self.tables = tables[0]
            if (tables != self.tables).any() or len(np.unique(self.tables)) < len(self.tables):
                self.grid = None


def sharing(q: Vectors, n: Vectors):
    """(rows of q, rows of n) that share a bucket, each pair once, part by part; or None where those are not few.

    Then both blocks have one key a row and table, so that equal places tell.
    """
    lo, hi = np.searchsorted(n.sorted, q.codes, "left"), np.searchsorted(n.sorted, q.codes, "right")
    n_ids, many = len(n.ids), int((hi - lo).sum()) > LISTED * len(q.ids) * len(n.ids)
    if many and q.grid is not None and n.grid is not None and np.array_equal(q.tables, n.tables):
        return None

    def listed():
        for at in range(0, len(q.ids), SLICE):
            end = min(at + SLICE, len(q.ids))
            a, b = q.first[at], q.first[end]
            counts = hi[a:b] - lo[a:b]
            rows = np.repeat(np.repeat(np.arange(at, end), np.diff(q.first[at : end + 1])), counts)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[a:b], counts)
            pair = np.unique(rows * n_ids + n.owner[place])
            yield pair // n_ids, pair % n_ids

    return listed()


def products(q: Vectors, n: Vectors, qi, ni) -> np.ndarray:
    """Inner products of rows, added up in the order of components as the column expression does; NaN for unlike widths."""
    out = np.zeros(len(qi))
    dim = min(q.dim, n.dim)
    for lo in range(0, len(qi), 1 << 14):
        a, b = q.x[qi[lo : lo + (1 << 14)], :dim].T.copy(), n.x[ni[lo : lo + (1 << 14)], :dim].T.copy()
        a *= b
        for row in a:
            out[lo : lo + (1 << 14)] += row
    return out


class Best:
    """The k first neighbours so far of each vector of a block, and what another has to reach."""

    def __init__(self, ids: np.ndarray, k: int, order: str):
        self.ids, self.k, self.order = ids, k, order
        self.qi, self.found, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(len(ids), -np.inf if order == "similarity" else np.inf)

    def add(self, qi, found, scores):
        qi, found, scores = np.concatenate([self.qi, qi]), np.concatenate([self.found, found]), np.concatenate([self.scores, scores])
        height = np.where(np.isnan(scores), np.inf, scores)
        at = np.lexsort((found, -height, qi) if self.order == "similarity" else (found, qi))
        starts = np.flatnonzero(np.concatenate([[True], qi[at][1:] != qi[at][:-1]])) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kth = at[rank == self.k - 1]
        self.floor[qi[kth]] = height[kth] if self.order == "similarity" else found[kth]
        at = at[rank < self.k]
        self.qi, self.found, self.scores = qi[at], found[at], scores[at]


def found_in(batches, threshold: float | None, k: int | None, order: str, apart, best: dict):
    """Record batches (query_id, neighbor_id, similarity) of what pairs of blocks have.

    Scores by matrix products leave out, with a margin for their rounding, what is under the threshold or the k-th found; the
    others' buckets are compared and their products taken anew.
    """
    n_block, n, asked = None, None, {}
    for batch in batches:
        for row in range(len(batch)):
            q_block = batch.column(2)[row].as_py()
            if n_block != (at := batch.column(0)[row].as_py()):
                n_block, n = at, Vectors(batch.column(1)[row])
            if q_block not in asked:
                asked[q_block] = Vectors(batch.column(3)[row])
                if k:
                    best[q_block] = Best(asked[q_block].ids, k, order)
            q = asked[q_block]
            kept = best.get(q_block)

            def good(qi, ni, q=q, n=n, kept=kept):
                there = apart(q.ids[qi], n.ids[ni]) & (q.widths[qi] == n.widths[ni])
                if kept is not None and order == "id":
                    there &= n.ids[ni] <= kept.floor[qi]
                qi, ni = qi[there], ni[there]
                scores = products(q, n, qi, ni)
                there = ~(scores < threshold) if threshold is not None else slice(None)
                qi, ni, scores = qi[there], ni[there], scores[there]
                if kept is not None:
                    kept.add(qi, n.ids[ni], scores)
                elif len(qi):
                    return pa.RecordBatch.from_arrays([pa.array(q.ids[qi]), pa.array(n.ids[ni]), pa.array(scores)], ["query_id", "neighbor_id", "similarity"])
                return None

            few = sharing(q, n)
            for qi, ni in few if few is not None else _scored(q, n, threshold, kept, order):
                if (out := good(qi, ni)) is not None:
                    yield out


def _scored(q: Vectors, n: Vectors, threshold, kept, order):
    with np.errstate(all="ignore"):
        margin = 1e-12 * max(1.0, q.length * n.length)
        margin = margin if np.isfinite(margin) else np.inf
        for lo in range(0, len(n.ids), SLICE):
            least = np.full(len(q.ids), -np.inf if threshold is None else threshold - margin)
            open_rows = np.arange(len(q.ids))
            if kept is not None and order == "similarity":
                least = np.maximum(least, kept.floor - margin)
            elif kept is not None:
                open_rows = np.flatnonzero(kept.floor >= n.ids[lo : lo + SLICE].min())
            dim = min(q.dim, n.dim)
            s = q.x[open_rows, :dim] @ n.x[lo : lo + SLICE, :dim].T
            there = ~(s < least[open_rows, None])
            if kept is not None and order == "id":
                there &= n.ids[None, lo : lo + SLICE] <= kept.floor[open_rows, None]
            qi, ni = np.nonzero(there)
            qi, ni = open_rows[qi], ni + lo
            same = np.zeros(len(qi), bool)
            for t in range(q.grid.shape[1]):
                same |= q.grid[qi, t] == n.grid[ni, t]
            yield qi[same], ni[same]


def search(queries: DataFrame, vectors: DataFrame, threshold: float | None, k: int | None = None, order: str = "similarity", earlier_only: bool = False) -> DataFrame:
    """(query_id, neighbor_id, similarity) of keyed blocks' rows that share a bucket; with k, of each task the k first of a query."""

    def run(batches):
        apart = (lambda a, b: b < a) if earlier_only else (lambda a, b: a != b)
        best = {}
        yield from found_in(batches, threshold, k, order, apart, best)
        for b in best.values():
            if len(b.qi):
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.qi]), pa.array(b.found), pa.array(b.scores)], ["query_id", "neighbor_id", "similarity"])

    earlier = F.col("n_low") < F.col("q_high") if earlier_only else None
    return met(vectors, queries, earlier).mapInArrow(run, "query_id long, neighbor_id long, similarity double")


#: Rows of a block of sparse queries, blocks of them that a task keeps, and entries that are multiplied together.
ASKED, ASKED_KEPT, ENTRIES = 64, 256, 1 << 14
#: Share by which a bound is lowered for rounding.
ROUNDING = 1e-9


def sparse_search(sparse: DataFrame, threshold: float, queries) -> DataFrame:
    """(query_id, neighbor_id, similarity) of sparse vectors, one row an id, that a condition names against all others.

    The threshold is over 0. No product is over that of the lengths: queries are packed by length, rows of a block go by length, and
    only those that are long enough for the longest query of a block are multiplied with it.
    """
    if not threshold > 0:
        raise ValueError("lengths bound the result only where the threshold is over 0")
    least = threshold * (1 - ROUNDING)
    length = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
    rows = sparse.filter("vector_id IS NOT NULL").select(F.col("vector_id").cast("long").alias("vector_id"), "indices", F.col("values").cast("array<double>").alias("values"), length.alias("length"))
    n = packed(rows, "length", falling=True)
    longest = n.agg(F.max("high")).first()[0] or 0.0

    def again(batches):
        for batch in batches:
            for data in batch.column(0):
                got = unpacked(data)
                yield got.set_column(2, "values", got.column(2).cast(pa.list_(pa.float64())))

    asked = n.select("data").mapInArrow(again, rows.schema).filter(queries).filter(F.col("length") * F.lit(longest) >= least)
    q = packed(asked.repartitionByRange(F.desc("length")).sortWithinPartitions(F.desc("length")), "length", ASKED)

    def run(batches):
        block, held = None, None
        for batch in batches:
            for row in range(len(batch)):
                if block != (at := batch.column(0)[row].as_py()):
                    block, held = at, _entries(batch.column(1)[row])
                yield from _sums(_entries(batch.column(3)[row]), held, threshold, least)

    return met(n, q, F.col("n_high") * F.col("q_high") >= least, ASKED_KEPT).mapInArrow(run, "query_id long, neighbor_id long, similarity double")


def _entries(data):
    """(ids, lengths, first entry of each row and the end, dimensions, values) of a block."""
    batch = unpacked(data)
    indices, values = batch.column(1), batch.column(2)
    first = np.concatenate([[0], np.cumsum(np.diff(indices.offsets.to_numpy()))])
    return batch.column(0).to_numpy(), batch.column(3).to_numpy(), first, indices.flatten(), values.flatten().to_numpy(zero_copy_only=False).astype(float)


def _sums(q, n, threshold: float, least: float):
    (q_ids, q_lengths, q_first, q_dims, q_values), (n_ids, n_lengths, n_first, n_dims, n_values) = q, n
    rows = int((n_lengths * q_lengths.max() >= least).sum())  # the longest come first
    if not rows:
        return
    coded = q_dims.dictionary_encode()
    table = np.zeros((len(coded.dictionary), len(q_ids)))
    np.add.at(table, (coded.indices.to_numpy(), np.repeat(np.arange(len(q_ids)), np.diff(q_first))), q_values)
    at = pc.fill_null(pc.index_in(n_dims.slice(0, n_first[rows]), value_set=coded.dictionary), -1).to_numpy()
    there = np.flatnonzero(at >= 0)
    owner = np.repeat(np.arange(rows), np.diff(n_first[: rows + 1]))[there]
    sums = np.zeros((rows, len(q_ids)))
    for lo in range(0, len(there), ENTRIES):
        mine, own = there[lo : lo + ENTRIES], owner[lo : lo + ENTRIES]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[starts]] += np.add.reduceat(table[at[mine]] * n_values[mine, None], starts, axis=0)
    ni, qi = np.nonzero((sums >= threshold) & (n_ids[:rows, None] != q_ids))
    if len(ni):
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(n_ids[ni]), pa.array(sums[ni, qi])], ["query_id", "neighbor_id", "similarity"])
