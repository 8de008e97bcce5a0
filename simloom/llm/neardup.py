"""N-gram Jaccard self-join by banded MinHash (op8)."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm import common, words
from simloom.llm.components import components

NGRAM, THRESHOLD = 5, 0.8
#: Wanted chance that a pair at the threshold meets in a band, and hash functions at most.
TARGET_RECALL, MOST_HASHES = 0.9999, 128
#: N-grams and documents of one block on average; a task verifies one block, or one block against another. A group gets up to
#: MOST_BLOCKS small blocks before its blocks grow.
BLOCK_GRAMS, LEAST_BLOCK, BLOCK_DOCS, MOST_BLOCKS = 1 << 20, 96, 512, 64
#: Rows of one block of a band's bucket.
BUCKET_ROWS = 512
#: Standard deviations that a pair's agreeing hashes may lie under what the threshold gives.
SLACK = 5
#: Columns of an incidence matrix.
COLUMNS = 4096


@functools.lru_cache
def choose_bands(threshold: float, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows whose bands reach the recall at the threshold within so many hash functions."""
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) if hit > 1e-12 else most + 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


def gram_sets(texts: list[str], n: int = NGRAM) -> list[np.ndarray]:
    """The sorted set of hashes of each text's word n-grams; a text of fewer words has one n-gram of all of them, one without words none."""
    hashes, counts = words.word_hashes(texts)
    ends = np.cumsum(counts)
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        grams = grams * words.BASE + hashes[k : k + len(grams)]
    grams = words.mix(grams)
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = h * words.BASE + hashes[k : k + 1]
            out.append(words.mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.lru_cache
def _functions(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = words.mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (seeds[:hashes] | np.uint64(1)).astype(np.uint32), seeds[hashes:].astype(np.uint32)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, bytes]:
    """The hash of each band of a set's MinHash signature, as signed 64-bit integers, and a sketch: one byte of each hash function."""
    a, b = _functions(bands * rows)
    low = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, (a[:, None] * low[at : at + 2048] + b[:, None]).min(1))
    h = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        h = words.mix(h * words.BASE + column)
    return h.view(np.int64), ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_agreement(threshold: float, hashes: int) -> int:
    """Bytes of two sketches that agree at least, but for SLACK standard deviations, where the sets' similarity is at the threshold."""
    return max(0, math.floor(hashes * threshold - SLACK * math.sqrt(hashes * threshold * (1 - threshold))))


def class_digest(grams: np.ndarray, text: str) -> bytes:
    """Names the texts of one n-gram set; texts without words are alike only if they are equal."""
    if len(grams):
        return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16, person=b"no words").digest()


def hashed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and text_hash, which tells rows of one id apart."""
    return common.id_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


def signatures(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, digest of the n-gram set, its size, sketch and band hashes (none for texts without words)."""
    bands, rows = choose_bands(threshold)
    names = ["doc_id", "text_hash", "digest", "size", "sketch", "bands"]

    def run(batches):
        for part, texts in common.text_slices(batches):
            sets = gram_sets(texts, n)
            made = [band_hashes(g, bands, rows) if len(g) else (np.zeros(0, np.int64), b"") for g in sets]
            columns = [
                part.column(0), part.column(2),
                pa.array([class_digest(g, t) for g, t in zip(sets, texts, strict=True)], pa.binary()),
                pa.array([len(g) for g in sets], pa.int64()),
                pa.array([x[1] for x in made], pa.binary()),
                pa.array([x[0] for x in made], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, text_hash long, digest binary, size long, sketch binary, bands array<long>"
    return hashed_text(docs, id_col, text_col).mapInArrow(run, schema)


def spanning_edges(sketches: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """(rows, the first row of the component of each) where rows whose sketches agree in at least so many bytes are joined; rows alone have no edge."""
    pending, found, roots = np.arange(len(sketches)), [], []
    while len(pending) > 1:
        root, pending = int(pending[0]), pending[1:]
        open_rows = [root]
        while open_rows and len(pending):
            near = (sketches[pending] == sketches[open_rows.pop()]).sum(1) >= least
            reached = pending[near].tolist()
            pending = pending[~near]
            open_rows += reached
            found += reached
            roots += [root] * len(reached)
    return found, roots


def _bucket_edges(least: int):
    """Edges (u, v) between nodes of one bucket task (band, i, j), from rows sorted by it."""

    def run(batches):
        key, nodes, sketches = None, [], []

        def flush():
            if len(nodes) < 2:
                return [], []
            order = np.argsort(nodes)
            names = np.array(nodes, np.int64)[order]
            found, roots = spanning_edges(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1)[order], least)
            return names[found].tolist(), names[roots].tolist()

        for batch in batches:
            u, v = [], []
            for band, i, j, node, sketch in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (band, i, j) != key:
                    a, b = flush()
                    u, v = u + a, v + b
                    key, nodes, sketches = (band, i, j), [], []
                nodes.append(node)
                sketches.append(sketch)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        u, v = flush()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def block_tasks(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (with node and blocks) once for each block that theirs meets: the columns, i, j, block."""
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select(columns[0], F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns[1:], "block")


def candidate_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges that join the classes which share a band and whose sketches do not rule out the threshold.

    Rows of a band's bucket meet block against block, so no bucket has to fit into one task; a task hands on a spanning forest.
    """
    bands, rows = choose_bands(threshold)
    banded = classes.select("node", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks"))
    met = banded.join(crowded, "band").join(classes.select("node", "sketch"), "node")
    tasks = block_tasks(met, "band", "node", "sketch").drop("block")
    dealt = tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(_bucket_edges(least_agreement(threshold, bands * rows)), "u long, v long").distinct()


def linked_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """A square matrix of which sets have a Jaccard similarity of at least threshold; none with itself."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
    both = np.zeros((m, m), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        there = np.zeros((m, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        there[owner[lo:hi], column[lo:hi] - at] = 1
        both += there @ there.T
    linked = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row of its component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        nxt = np.minimum(label, near)
        nxt = np.minimum(nxt, nxt[nxt])
        if (nxt == label).all():
            return label
        label = nxt


def verify(ids: np.ndarray, copies: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool):
    """(links, smallest linked id) of each class of one task; across two blocks, pairs within one are left to its own task."""
    linked = linked_pairs(sets, threshold)
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    return linked @ copies, ids[least_labels(linked)]


def _tasks(threshold: float):
    """Verifies runs of rows of one task (component, i, j), sorted by it."""

    def run(batches):
        key, held = None, {}

        def flush():
            if len(held) > 1:
                ids = np.array(sorted(held), np.int64)
                copies = np.array([held[k][0] for k in ids.tolist()], np.int64)
                blocks = np.array([held[k][2] for k in ids.tolist()], np.int64)
                links, roots = verify(ids, copies, blocks, [np.frombuffer(held[k][1], np.uint64) for k in ids.tolist()], threshold, key[1] != key[2])
                some = links > 0
                return [ids[some], links[some], roots[some]]
            return [np.zeros(0, np.int64)] * 3

        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if row[:3] != key:
                    out.append(flush())
                    key, held = row[:3], {}
                held[row[3]] = row[4:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], ["node", "links", "root"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flush()], ["node", "links", "root"])

    return run


def _shingle(n: int):
    """The n-gram set of each class from the text of its first row; a row that repeats is taken once by each task."""

    def run(batches):
        seen: set[int] = set()
        for part, texts in common.text_slices(batches, column=5):
            sets = gram_sets(texts, n)
            fits = []
            for node, digest, g, t in zip(part.column(1).to_pylist(), part.column(4).to_pylist(), sets, texts, strict=True):
                fits.append(node not in seen and class_digest(g, t) == digest)
                seen.add(node)
            columns = [*part.columns[:4], pa.array([g.tobytes() for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["component", "node", "copies", "blocks", "grams"]).filter(pa.array(fits, pa.bool_()))

    return run


def link_rows(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document row: doc_id, text_hash, rep_id, class_id, class_hash, n_links; see jaccard_join.

    class_id and class_hash name the first row of the class, by id, then by the hash of its text.
    """
    sig = common.cut(signatures(docs, n, threshold, id_col, text_col), gather=True)
    known = sig.filter(F.col("doc_id").isNotNull())
    grouped = known.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
    )
    classes = common.cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    comps = components(candidate_edges(classes, threshold))
    members = comps.join(classes.select("node", "first", "digest", "size", "copies"), "node")
    sizes = members.groupBy("component").agg(F.sum("size").alias("grams"), F.count("*").alias("docs"))
    block = F.least(F.lit(BLOCK_DOCS), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("docs") / MOST_BLOCKS)))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("docs") / block)).cast("int")
    members = members.join(sizes.select("component", blocks.alias("blocks")), "component")
    members = members.select("component", "node", "copies", "blocks", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    rows = hashed_text(docs, id_col, text_col).join(members.hint("shuffle_hash"), ["doc_id", "text_hash"])
    sets = rows.select("component", "node", "copies", "blocks", "digest", "text").mapInArrow(_shingle(n), "component long, node long, copies long, blocks int, grams binary")
    tasks = block_tasks(common.cut(sets), "component", "node", "copies", "grams")  # sampling for ranges reads the sets again
    dealt = tasks.repartitionByRange("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = common.cut(dealt.mapInArrow(_tasks(threshold), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found, "node", "root")
    table = classes.select("digest", "node", "first", "copies").join(links, "node", "left").join(named, "node", "left")
    heads = table.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("head"))
    table = table.join(heads, "component", "left").withColumn("head", F.coalesce("head", "first"))
    table = table.select(
        "digest", F.col("first.doc_id").alias("rep_id"), F.col("head.doc_id").alias("class_id"), F.col("head.text_hash").alias("class_hash"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    keyed = sig.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return keyed.join(table, "digest", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).drop("digest")


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links between documents whose word n-gram sets have a Jaccard similarity of at least threshold.

    Returns one row a document: doc_id, rep_id (the smallest id with the same n-gram set), class_id (the smallest id of those
    that links join, however far), n_links (other documents, copies included, that it is linked to). A document without a
    link is its own class. Texts without words, null and empty ones among them, are linked to equal texts only (null counts as
    empty). Rows with a null id have null classes and no links; rows that repeat an id count as documents each, whether their
    texts are equal or not; other columns are not read; an empty table gives an empty one.

    Plan: equal sets become one class under a number of its own. Classes are shuffled on band hashes. Rows of a bucket meet
    block by block, and a pair whose MinHash sketches lie SLACK standard deviations under the threshold goes at once (a pair at
    the threshold is lost so with a chance under one in a million), so chance meetings join nothing; the components of the other
    pairs are dealt out as tasks, each class with its full n-gram set once. A component beyond one block is cut into blocks by
    a hash, and each pair of blocks is a task; so no group, however large, has to fit into one. Tasks are dealt by ranges of
    about equal rows. A task finds all links by products of incidence matrices and hands on one row a class, never pairs.
    """
    return link_rows(docs, n, threshold, id_col, text_col).select("doc_id", "rep_id", "class_id", "n_links")


def keep_first_rows(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of jaccard_join: that of the smallest id; of rows of one id that of the smallest text hash.

    Rows equal in id and text stay as one row, whatever their other columns hold. Rows with a null id stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), row)
    found = link_rows(docs, n, threshold, id_col, text_col).filter(F.col("doc_id").isNotNull())
    first = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    marks = found.groupBy("doc_id", "text_hash").agg(F.first(first).alias("stays"), F.count("*").alias("n"))
    marks = common.cut(marks.filter("n > 1 OR NOT stays").select("doc_id", "text_hash", "stays"))
    marked = keyed.join(marks.hint("shuffle_hash"), ["doc_id", "text_hash"], "left")
    kept = marked.filter(F.col("stays").isNull()).select("row.*")
    if marks.filter("stays").isEmpty():
        return kept
    again = marked.filter("stays").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return kept.unionByName(again.select("row.*"))


#: DuckDB SQL of the query: every pair of documents that share an n-gram is compared, so it is for small tables.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE ['no words' || chr(10) || text] END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS gram, len(s) AS n FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
c AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT p.b AS node, c.root FROM c JOIN p ON p.a = c.node),
k AS (SELECT node, min(root) AS class_id FROM c GROUP BY node),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT g.doc_id, min(g.doc_id) OVER (PARTITION BY g.s) AS rep_id, k.class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM g JOIN k ON k.node = g.doc_id LEFT JOIN l ON l.a = g.doc_id
"""
