"""Queries over vectors and their SQL twins.

The hash functions come from a closed integer form, so that both sides derive the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import hashing, similarity, vectors
from simloom.operators import adaptive, bitset, blocks, evaluate, index, search
from simloom.operators.families import AngleFamily, PrecalculatedFamily, PStableFamily, scrambled, scrambled_planes
from simloom.sources import shared, text

TABLES, CHAIN, DIM = 8, 6, 64
THRESHOLD, K = 0.3, 10
#: Bytes of a table that may be broadcast, after its size was checked.
BROADCAST_BYTES = 32 << 20
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").cast("array<double>").alias("values"))


def angle_family() -> AngleFamily:
    return AngleFamily(scrambled_planes(TABLES, CHAIN, DIM))


def deep_family() -> AngleFamily:
    return AngleFamily(scrambled_planes(4, 16, DIM))


def pstable_family() -> PStableFamily:
    a = scrambled_planes(TABLES, 4, DIM, 8.0)
    t, j = scrambled([[(t + 50) * 1000 + j for j in range(4)] for t in range(TABLES)]), 4
    return PStableFamily(a, t % j, t * 0 + j)


def precalculated_family() -> PrecalculatedFamily:
    pairs = scrambled([[9000 + t, 9100 + t] for t in range(TABLES)]) % 6
    return PrecalculatedFamily(AngleFamily(scrambled_planes(6, 3, DIM)), pairs)


def second_family() -> AngleFamily:
    return AngleFamily(scrambled_planes(1, 4, 32))


def angle_index(spark, sf_dir):
    return index.build_index(embeddings(spark, sf_dir), angle_family())




def planes_sql(name: str, tables: int, chain: int, dim: int, scale: str = "1") -> str:
    return f"""{name}_0 AS (SELECT t, j, d, CAST((t * 1000 + j) * 1000 + d + 1 AS BIGINT) AS x FROM range({tables}) a(t), range({chain}) b(j), range({dim}) c(d)),
{name}_1 AS (SELECT t, j, d, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM {name}_0),
{name}_2 AS (SELECT t, j, d, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM {name}_1),
{name} AS (SELECT t, j, list({scale} * (CAST(xor(x >> 16, x) % 2003 - 1001 AS DOUBLE) / CAST(1001 AS DOUBLE)) ORDER BY d) AS a FROM {name}_2 GROUP BY t, j)"""


VECTORS_SQL = "v AS (SELECT vec_id AS vector_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def keys_sql(name: str, planes: str, tables: int, chain: int) -> str:
    return f"""{planes_sql(planes, tables, chain, DIM)},
{name}_u AS (SELECT vector_id, t, CAST(sum(CASE WHEN list_dot_product(e, a) > 0 THEN CAST(1 AS BIGINT) << (31 - j) ELSE 0 END) AS BIGINT) AS u FROM v, {planes} GROUP BY vector_id, t),
{name} AS (SELECT CAST(t AS INTEGER) AS table_id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INTEGER) AS bucket_key, u, vector_id FROM {name}_u)"""


ANGLE_SQL = f"WITH {VECTORS_SQL}, {keys_sql('k', 'p', TABLES, CHAIN)}"
PAIRS_SQL = f"{ANGLE_SQL}, pairs AS (SELECT DISTINCT q.vector_id AS query_id, n.vector_id AS neighbor_id FROM k q JOIN k n USING (table_id, bucket_key) WHERE q.vector_id <> n.vector_id)"
SCORED_SQL = f"""{PAIRS_SQL}, scored AS (SELECT query_id, neighbor_id, list_dot_product(a.e, b.e) AS similarity
  FROM pairs JOIN v a ON a.vector_id = query_id JOIN v b ON b.vector_id = neighbor_id)"""
EXACT_SQL = """ex0 AS (SELECT a.vector_id AS query_id, b.vector_id AS neighbor_id, list_dot_product(a.e, b.e) AS similarity FROM v a JOIN v b ON a.vector_id <> b.vector_id WHERE a.vector_id % 20 = 0),
ex AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank FROM ex0) WHERE rank <= 10)"""


def queried(df, column="vector_id"):
    """The stated query set: ids divisible by 20."""
    return df.filter(F.col(column) % 20 == 0)


@query(f"""WITH {VECTORS_SQL} SELECT vector_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, CAST(len(e) AS INTEGER) AS dim,
  round(list_sum(e) / sqrt(list_dot_product(e, e)), 6) AS unit_sum FROM v""")
def vector_norm_dot(spark, sf_dir):
    v, e = embeddings(spark, sf_dir), F.col("values")
    unit = F.aggregate(vectors.normalize(e), F.lit(0.0), lambda s, x: s + x)
    return v.select("vector_id", F.round(similarity.norm(e), 6).alias("norm"), F.size(e).alias("dim"), F.round(unit, 6).alias("unit_sum"))


@query(f"""WITH {VECTORS_SQL} SELECT a.vector_id, b.vector_id AS other_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine,
  round(acos(least(list_dot_product(a.e, b.e), 1.0)), 6) AS angle FROM v a JOIN v b ON b.vector_id = a.vector_id + 1""")
def cosine_angle_pairs(spark, sf_dir):
    a = embeddings(spark, sf_dir)
    b = a.select((F.col("vector_id") - 1).alias("vector_id"), F.col("vector_id").alias("other_id"), F.col("values").alias("o"))
    cos, dot = similarity.cosine(F.col("values"), F.col("o")), similarity.dot(F.col("values"), F.col("o"))
    return a.join(b, "vector_id").select("vector_id", "other_id", F.round(cos, 6).alias("cosine"), F.round(similarity.angular_distance(dot), 6).alias("angle"))


@query(f"WITH {VECTORS_SQL}, {EXACT_SQL} SELECT query_id, neighbor_id, rank, round(similarity, 6) AS similarity FROM ex")
def knn_exact_topk(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return search.exact_knn(queried(v), v, K).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {VECTORS_SQL}, {EXACT_SQL} SELECT query_id, neighbor_id, round(similarity, 6) AS similarity FROM ex0 WHERE similarity >= 0.3")
def similarity_threshold_pairs(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return search.exact_knn(queried(v), v, None, THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query(f"{ANGLE_SQL} SELECT table_id, bucket_key, vector_id FROM k")
def angle_bucket_keys(spark, sf_dir):
    return angle_index(spark, sf_dir)


@query(f"""WITH {VECTORS_SQL}, {planes_sql('p', TABLES, 4, DIM, '8')},
b0 AS (SELECT t, j, CAST((t + 50) * 1000 + j AS BIGINT) AS x FROM range({TABLES}) a(t), range(4) b(j)),
b1 AS (SELECT t, j, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM b0),
b2 AS (SELECT t, j, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM b1),
b AS (SELECT t, j, xor(x >> 16, x) % 4 AS b FROM b2),
i AS (SELECT vector_id, t, j, CAST(trunc((list_dot_product(e, a) + b) / 4) AS BIGINT) AS i FROM v, p JOIN b USING (t, j)),
y AS (SELECT vector_id, t, list_concat([CAST(1 AS BIGINT)], flatten(list([xor((i >> 24) & 255, 128) - 128, xor((i >> 16) & 255, 128) - 128, xor((i >> 8) & 255, 128) - 128, xor(i & 255, 128) - 128] ORDER BY j))) AS y FROM i GROUP BY vector_id, t),
h AS (SELECT vector_id, t, list_reduce(y, lambda h, c: (h * 31 + c) & 4294967295) AS u FROM y)
SELECT CAST(t AS INTEGER) AS table_id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INTEGER) AS bucket_key, vector_id FROM h""")
def pstable_bucket_keys(spark, sf_dir):
    return index.build_index(embeddings(spark, sf_dir), pstable_family())


@query(f"""WITH {VECTORS_SQL}, {keys_sql('k', 'p', 6, 3)},
r0 AS (SELECT t, s, CAST(9000 + 100 * s + t AS BIGINT) AS x FROM range({TABLES}) a(t), range(2) b(s)),
r1 AS (SELECT t, s, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM r0),
r2 AS (SELECT t, s, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM r1),
r AS (SELECT t, max(CASE WHEN s = 0 THEN xor(x >> 16, x) % 6 END) AS i, max(CASE WHEN s = 1 THEN xor(x >> 16, x) % 6 END) AS j FROM r2 GROUP BY t),
c AS (SELECT a.vector_id, r.t, (((a.u >> 29) << 3) + (b.u >> 29)) << 26 AS u FROM r JOIN k a ON a.table_id = r.i JOIN k b ON b.table_id = r.j AND a.vector_id = b.vector_id)
SELECT CAST(t AS INTEGER) AS table_id, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INTEGER) AS bucket_key, vector_id FROM c""")
def precalc_bucket_keys(spark, sf_dir):
    return index.build_index(embeddings(spark, sf_dir), precalculated_family())


@query("""WITH a AS (SELECT o_orderkey, (xor(o_orderkey >> 16, o_orderkey) * 73244475) & 4294967295 AS x FROM orders),
b AS (SELECT o_orderkey, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM a)
SELECT o_orderkey, xor(x >> 16, x) AS hash FROM b""")
def scramble_int_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.scramble(F.col("o_orderkey")).alias("hash"))


@query("""WITH b AS (SELECT o_orderkey, list_concat([CAST(1 AS BIGINT)], [xor((o_orderkey >> 24) & 255, 128) - 128, xor((o_orderkey >> 16) & 255, 128) - 128, xor((o_orderkey >> 8) & 255, 128) - 128, xor(o_orderkey & 255, 128) - 128]) AS y FROM orders),
h AS (SELECT o_orderkey, list_reduce(y, lambda h, c: (h * 31 + c) & 4294967295) AS u FROM b)
SELECT o_orderkey, CAST(CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS INTEGER) AS hash FROM h""")
def byte_array_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.ints_hash(F.array(F.col("o_orderkey").cast("int"))).alias("hash"))


@query(f"{PAIRS_SQL} SELECT * FROM pairs WHERE query_id % 20 = 0")
def lsh_candidates(spark, sf_dir):
    i = angle_index(spark, sf_dir)
    return search.candidates(queried(i), i)


@query(f"""{SCORED_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank FROM scored WHERE similarity >= 0.3)
SELECT query_id, neighbor_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 10""")
def lsh_topk_similarity(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return search.lsh_search(v, index.build_index(v, angle_family()), K, THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query(f"""{SCORED_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY neighbor_id) AS INTEGER) AS rank FROM scored WHERE similarity >= 0)
SELECT query_id, neighbor_id, rank, round(similarity, 6) AS similarity FROM r WHERE rank <= 5""")
def lsh_topk_by_id(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return search.lsh_search(v, index.build_index(v, angle_family()), 5, 0.0, "id").withColumn("similarity", F.round("similarity", 6))


THEN_INSERT_SQL = f"{SCORED_SQL} SELECT query_id, neighbor_id, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.3 AND neighbor_id < query_id"


@query(THEN_INSERT_SQL)
def lsh_search_then_insert(spark, sf_dir):
    v = embeddings(spark, sf_dir)
    return search.search_then_insert(v, index.build_index(v, angle_family()), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query(f"{ANGLE_SQL} SELECT table_id, bucket_key, count(*) AS n FROM k GROUP BY ALL")
def bucket_histogram(spark, sf_dir):
    return index.bucket_counts(angle_index(spark, sf_dir))


OFFSETS_SQL = f"""{ANGLE_SQL}, c AS (SELECT table_id, bucket_key, count(*) AS n FROM k GROUP BY ALL),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY table_id ORDER BY bucket_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot FROM c)"""


@query(f"{OFFSETS_SQL} SELECT * FROM o")
def bucket_offsets(spark, sf_dir):
    return index.bucket_offsets(angle_index(spark, sf_dir))


@query(f"{ANGLE_SQL} SELECT table_id, bucket_key, vector_id, row_number() OVER (PARTITION BY table_id ORDER BY bucket_key, vector_id) - 1 AS slot FROM k")
def vector_slots(spark, sf_dir):
    return index.vector_slots(angle_index(spark, sf_dir))


@query(f"""{ANGLE_SQL}, {planes_sql('s', 1, 4, 32)},
l AS (SELECT table_id, bucket_key, u, vector_id, list_transform(range(32), lambda i: CAST((u >> i) & 1 AS DOUBLE)) AS bits FROM k),
q AS (SELECT table_id, bucket_key, u, vector_id, CAST(sum(CASE WHEN list_dot_product(bits, a) > 0 THEN CAST(1 AS BIGINT) << (3 - j) ELSE 0 END) AS INTEGER) AS partition_id FROM l, s GROUP BY ALL)
SELECT table_id, bucket_key, vector_id, partition_id, CAST(u >> 28 AS INTEGER) AS segment_id, CAST((vector_id % 16 + 16) % 16 AS INTEGER) AS hash_partition FROM q""")
def ls_partition_assignment(spark, sf_dir):
    key = F.col("bucket_key")
    return angle_index(spark, sf_dir).select(
        "table_id", "bucket_key", "vector_id", index.locality_partition(key, second_family(), 4).alias("partition_id"),
        index.segment(key, 28).alias("segment_id"), index.hash_partition(F.col("vector_id"), 16).alias("hash_partition"),
    )


GEOMETRY = adaptive.Geometry(bucket_bits=28, directory_size=8, hash_bits=32, overflow=4)


def leaves_sql(geometry: adaptive.Geometry = GEOMETRY) -> str:
    shifts = range(geometry.top_level * geometry.level_bits, -1, -geometry.level_bits)
    parts, names = [f"CAST(u >> {geometry.bucket_bits} AS VARCHAR)"], []
    for s in shifts:
        parts.append(f"CAST((u >> {s}) & {geometry.directory_size - 1} AS VARCHAR)")
        names.append(f"concat_ws('/', {', '.join(parts)}) AS p{len(names)}")
    last = len(names) - 1
    counts = ", ".join(f"count(*) OVER (PARTITION BY table_id, p{i}) AS c{i}" for i in range(last))
    leaf = " ".join(f"WHEN c{i} <= {geometry.overflow} THEN p{i}" for i in range(last))
    depth = " ".join(f"WHEN c{i} <= {geometry.overflow} THEN {i + 1}" for i in range(last))
    return f"""WITH {VECTORS_SQL}, {keys_sql('k', 'p', 4, 16)}, paths AS (SELECT table_id, bucket_key, vector_id, {', '.join(names)} FROM k),
counted AS (SELECT *, {counts} FROM paths),
leaves AS (SELECT table_id, bucket_key, vector_id, CASE {leaf} ELSE p{last} END AS leaf, CAST(CASE {depth} ELSE {last + 1} END AS INTEGER) AS depth FROM counted)"""


def deep_leaves(spark, sf_dir):
    return adaptive.assign_leaves(index.build_index(embeddings(spark, sf_dir), deep_family()), GEOMETRY)


@query(f"{leaves_sql()} SELECT * FROM leaves")
def adaptive_leaf_buckets(spark, sf_dir):
    return deep_leaves(spark, sf_dir)


@query(f"{leaves_sql()} SELECT table_id, leaf, count(*) AS n, max(depth) AS depth FROM leaves GROUP BY ALL")
def adaptive_leaf_sizes(spark, sf_dir):
    return adaptive.leaf_sizes(deep_leaves(spark, sf_dir))


@query(f"{leaves_sql()} SELECT DISTINCT q.vector_id AS query_id, n.vector_id AS neighbor_id FROM leaves q JOIN leaves n USING (table_id, leaf) WHERE q.vector_id <> n.vector_id AND q.vector_id % 20 = 0")
def adaptive_candidates(spark, sf_dir):
    leaves = deep_leaves(spark, sf_dir)
    return adaptive.candidates(leaves, queries=queried(leaves))


def ordered_leaves_sql() -> str:
    """Level by level: what had arrived when a bucket was made, and when it splits."""
    shifts = range(GEOMETRY.top_level * GEOMETRY.level_bits, -1, -GEOMETRY.level_bits)
    parts, names = ["CAST(u >> 28 AS VARCHAR)"], []
    for s in shifts:
        parts.append(f"CAST((u >> {s}) & 7 AS VARCHAR)")
        names.append(f"concat_ws('/', {', '.join(parts)}) AS p{len(names)}")
    over, last = GEOMETRY.overflow, len(names) - 1
    steps = [f"WITH {VECTORS_SQL}, {keys_sql('k', 'p', 4, 16)}, a0 AS (SELECT table_id, bucket_key, vector_id, CAST(-1 AS BIGINT) AS since, {', '.join(names)} FROM k)"]
    for d in range(last):
        steps.append(f"""s{d} AS (SELECT table_id, p{d}, count(*) FILTER (vector_id <= since) AS made, min(vector_id) FILTER (vector_id > since) AS nxt, list(vector_id ORDER BY vector_id)[{over + 1}] AS filled
  FROM a{d} GROUP BY table_id, p{d} HAVING count(*) > greatest({over}, count(*) FILTER (vector_id <= since)))""")
        steps.append(f"a{d + 1} AS (SELECT a{d}.* REPLACE (CASE WHEN made <= {over} THEN filled ELSE nxt END AS since) FROM a{d} JOIN s{d} USING (table_id, p{d}))")
    reached = " UNION ALL ".join(f"SELECT table_id, vector_id, bucket_key, p{d} AS leaf, {d + 1} AS depth FROM a{d}" for d in range(last + 1))
    return ", ".join(steps) + f", r AS ({reached}) SELECT table_id, bucket_key, vector_id, leaf, CAST(depth AS INTEGER) AS depth FROM r QUALIFY row_number() OVER (PARTITION BY table_id, vector_id ORDER BY depth DESC) = 1"


@query(ordered_leaves_sql())
def adaptive_leaves_in_order(spark, sf_dir):
    return adaptive.assign_leaves(index.build_index(embeddings(spark, sf_dir), deep_family()), GEOMETRY, "order_exact")


TAGGED_SQL = f"WITH {VECTORS_SQL}, {keys_sql('k', 'p', 4, 16)}, tags AS (SELECT table_id, vector_id, CAST(l AS INTEGER) AS level, (u >> (24 - 8 * l)) + ((l + 1) << 32) AS prefix_key FROM k, range(4) r(l))"


@query(f"{TAGGED_SQL} SELECT * FROM tags")
def prefix_tagged_keys(spark, sf_dir):
    return adaptive.prefix_probes(index.build_index(embeddings(spark, sf_dir), deep_family()))


PREFIX_LEAVES_SQL = f"""{TAGGED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY table_id, level, prefix_key) AS n FROM tags),
leaves AS (SELECT table_id, vector_id, level, prefix_key FROM c WHERE level = 3 OR n <= 3 QUALIFY row_number() OVER (PARTITION BY table_id, vector_id ORDER BY level) = 1)"""


@query(f"{PREFIX_LEAVES_SQL} SELECT * FROM leaves")
def prefix_leaf_keys(spark, sf_dir):
    return adaptive.prefix_leaves(index.build_index(embeddings(spark, sf_dir), deep_family()), 3).select("table_id", "vector_id", "level", "prefix_key")


@query(f"{PREFIX_LEAVES_SQL} SELECT DISTINCT q.vector_id AS query_id, n.vector_id AS neighbor_id FROM leaves q JOIN leaves n USING (table_id, prefix_key) WHERE q.vector_id <> n.vector_id AND q.vector_id % 20 = 0")
def prefix_candidates(spark, sf_dir):
    leaves = adaptive.prefix_leaves(index.build_index(embeddings(spark, sf_dir), deep_family()), 3)
    return adaptive.prefix_candidates(leaves, queried(leaves))


@query(f"""{ANGLE_SQL}, s AS (SELECT vector_id, CAST(((bucket_key >> 26) % 4 + 4) % 4 AS INTEGER) AS shard_id, list(table_id ORDER BY table_id) AS l FROM k GROUP BY 1, 2)
SELECT vector_id, shard_id, list_concat(l, list_transform(range(8 - len(l)), lambda x: CAST(-1 AS INTEGER))) AS table_ids FROM s""")
def shard_allocation(spark, sf_dir):
    spread = angle_index(spark, sf_dir).withColumn("bucket_key", F.shiftright("bucket_key", 26))
    return index.shard_allocation(spread, 4, TABLES)


def approximate(spark, sf_dir, k=K):
    v = embeddings(spark, sf_dir)
    i = index.build_index(v, angle_family())
    return v, search.lsh_search(v, i, k, None, queries=queried(v), query_index=queried(i))


APPROX_SQL = f"{SCORED_SQL}, {EXACT_SQL}, ap AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) AS INTEGER) AS rank FROM scored WHERE query_id % 20 = 0) WHERE rank <= 10)"
RATIO_SQL = f"""{APPROX_SQL}, ratios AS (SELECT e.query_id, avg(acos(least(coalesce(a.similarity, 0), 1)) / acos(least(e.similarity, 1))) AS ratio
  FROM ex e LEFT JOIN ap a ON a.query_id = e.query_id AND a.rank = e.rank GROUP BY e.query_id)"""


@query(f"{RATIO_SQL} SELECT query_id, round(ratio, 6) AS ratio, CAST(0 AS BIGINT) AS undefined FROM ratios")
def ann_ratio(spark, sf_dir):
    v, found = approximate(spark, sf_dir)
    return evaluate.approximation_ratio(found, search.exact_knn(queried(v), v, K)).withColumn("ratio", F.round("ratio", 6))


@query(f"{RATIO_SQL} SELECT round(avg(ratio), 6) AS mean_ratio, count(ratio) AS queries FROM ratios")
def ann_mean_ratio(spark, sf_dir):
    v, found = approximate(spark, sf_dir)
    return evaluate.mean_ratio(evaluate.approximation_ratio(found, search.exact_knn(queried(v), v, K))).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(f"{APPROX_SQL} SELECT e.query_id, count(a.query_id) / CAST(count(*) AS DOUBLE) AS recall FROM ex e LEFT JOIN ap a ON a.query_id = e.query_id AND a.neighbor_id = e.neighbor_id GROUP BY e.query_id")
def ann_recall(spark, sf_dir):
    v, found = approximate(spark, sf_dir)
    return evaluate.recall(found, search.exact_knn(queried(v), v, K))


EFFICIENCY_SQL = f"""{PAIRS_SQL}, eff AS (SELECT v.vector_id AS query_id, count(neighbor_id) AS candidates, CAST(CASE WHEN count(neighbor_id) >= 10 THEN floor(count(neighbor_id) / 10) ELSE 0 END AS BIGINT) AS efficiency, count(neighbor_id) >= 10 AS over_hit
  FROM v LEFT JOIN pairs ON query_id = vector_id WHERE v.vector_id % 20 = 0 GROUP BY v.vector_id)"""


@query(f"{EFFICIENCY_SQL} SELECT * FROM eff")
def ann_efficiency(spark, sf_dir):
    v, i = embeddings(spark, sf_dir), angle_index(spark, sf_dir)
    return evaluate.efficiency(search.candidates(queried(i), i), queried(v).select(F.col("vector_id").alias("query_id")), K)


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT q.share, s.value FROM s JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) q(share) ON s.place = CAST(trunc(n * q.share) AS BIGINT)""")
def percentile_summary(spark, sf_dir):
    return evaluate.percentile_summary(table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, count(value) AS n, max(value) AS max_value, min(value) AS min_value, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return evaluate.summary(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("avg_value", F.round("avg_value", 6))


@query("""WITH u AS (SELECT user_id, avg(value) AS own FROM events GROUP BY user_id)
SELECT count(own) AS clients, round(max(own), 6) AS max_value, round(min(own), 6) AS min_value, round(avg(own), 6) AS avg_value FROM u""")
def client_latency_summary(spark, sf_dir):
    out = evaluate.client_summary(table(spark, sf_dir, "events"), "user_id", "value")
    return out.select("clients", *[F.round(c, 6).alias(c) for c in ("max_value", "min_value", "avg_value")])


@query("""WITH t AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1000000 AS DOUBLE) AS seconds FROM events)
SELECT n, round(seconds, 6) AS seconds, round(n / seconds, 6) AS per_second FROM t""")
def throughput_summary(spark, sf_dir):
    out = evaluate.throughput(table(spark, sf_dir, "events"), "ts")
    return out.withColumns({"seconds": F.round("seconds", 6), "per_second": F.round("per_second", 6)})


def supplier_vectors(spark, sf_dir):
    """Suppliers as sparse vectors over parts, by quantity."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vector_id"), F.col("l_partkey").cast("int").alias("i")).agg(F.sum("l_quantity").alias("v"))
    grouped = pairs.groupBy("vector_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return grouped.select("vector_id", F.transform("p", lambda x: x["i"]).alias("indices"), F.transform("p", lambda x: x["v"]).alias("values"))


SUPPLIER_SQL = "WITH s AS (SELECT l_suppkey AS vector_id, CAST(l_partkey AS INTEGER) AS dimension, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


@query(f"{SUPPLIER_SQL} SELECT * FROM s")
def inverted_index_postings(spark, sf_dir):
    return search.postings(supplier_vectors(spark, sf_dir))


@query(f"{SUPPLIER_SQL} SELECT DISTINCT a.vector_id AS query_id, b.vector_id AS neighbor_id FROM s a JOIN s b USING (dimension) WHERE a.vector_id <> b.vector_id AND a.vector_id % 20 = 0")
def inverted_index_candidates(spark, sf_dir):
    return search.sparse_join(supplier_vectors(spark, sf_dir), float("-inf"), queries="vector_id % 20 = 0").select("query_id", "neighbor_id")


@query(f"""{SUPPLIER_SQL} SELECT a.vector_id AS query_id, b.vector_id AS neighbor_id, round(sum(a.value * b.value), 6) AS similarity
FROM s a JOIN s b USING (dimension) WHERE a.vector_id < b.vector_id GROUP BY 1, 2 HAVING sum(a.value * b.value) >= 1000""")
def sparse_dot_join(spark, sf_dir):
    return search.sparse_join(supplier_vectors(spark, sf_dir), 1000.0).withColumn("similarity", F.round("similarity", 6))


@query("""WITH t AS (SELECT doc_id AS vector_id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS token FROM documents WHERE text IS NOT NULL),
c AS (SELECT vector_id, token, count(*) AS value FROM t WHERE token <> '' GROUP BY ALL),
d AS (SELECT token, dense_rank() OVER (ORDER BY token) - 1 AS dimension FROM (SELECT DISTINCT token FROM c))
SELECT dimension, vector_id, value FROM c JOIN d USING (token)""")
def token_postings(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vector_id"), F.explode(F.split(F.trim(F.lower("text")), r"\s+")).alias("token"))
    counts = words.filter("token <> ''").groupBy("vector_id", "token").agg(F.count("*").alias("value"))
    numbered = shared.cut(text.number_rows(words.filter("token <> ''").select("token").distinct(), "token", "dimension"))
    small = numbered.agg(F.sum(F.octet_length("token") + 24)).first()[0] or 0
    joined = counts.join(F.broadcast(numbered), "token") if small <= BROADCAST_BYTES else search.salted_join(counts, numbered, "token")
    return joined.select("dimension", "vector_id", "value")


@query("""WITH t AS (SELECT doc_id AS vector_id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS token FROM documents WHERE text IS NOT NULL),
c AS (SELECT vector_id, token, CAST(count(*) AS DOUBLE) AS value FROM t WHERE token <> '' GROUP BY ALL)
SELECT a.vector_id AS query_id, b.vector_id AS neighbor_id, sum(a.value * b.value) AS similarity
FROM c a JOIN c b USING (token) WHERE a.vector_id % 20 = 0 AND a.vector_id <> b.vector_id GROUP BY 1, 2 HAVING sum(a.value * b.value) >= 20000""")
def token_dot_join(spark, sf_dir):
    """Documents of the stated query set against all, by inner product of token counts."""
    texts = table(spark, sf_dir, "documents").filter("text IS NOT NULL").groupBy(F.col("doc_id").alias("vector_id")).agg(F.collect_list("text").alias("texts"))
    words = F.flatten(F.transform("texts", lambda t: F.split(F.trim(F.lower(t)), r"\s+")))
    sparse = text.counted(texts.select("vector_id", F.filter(words, lambda w: w != "").alias("words")), "words")
    return blocks.sparse_search(sparse, 20_000.0, F.col("vector_id") % 20 == 0)


def order_sets(spark, sf_dir):
    a = bitset.words(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'"), "o_orderkey")
    b = bitset.words(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), "l_orderkey")
    return a, b


SETS_SQL = "WITH a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"


@query(f"{SETS_SQL} SELECT id FROM a UNION SELECT id FROM b")
def bitset_or(spark, sf_dir):
    return bitset.members(bitset.union(*order_sets(spark, sf_dir)))


@query(f"{SETS_SQL} SELECT id FROM a INTERSECT SELECT id FROM b")
def bitset_and(spark, sf_dir):
    return bitset.members(bitset.intersection(*order_sets(spark, sf_dir)))


@query(f"{SETS_SQL} SELECT id FROM a EXCEPT SELECT id FROM b")
def bitset_difference(spark, sf_dir):
    return bitset.members(bitset.difference(*order_sets(spark, sf_dir)))


@query(f"{SETS_SQL}, g AS (SELECT DISTINCT id // 1024 AS page FROM a) SELECT page * 1024 + k AS id FROM g, range(1024) r(k) EXCEPT SELECT id FROM a")
def bitset_flip(spark, sf_dir):
    return bitset.members(bitset.flip(order_sets(spark, sf_dir)[0]))


@query(f"{SETS_SQL} SELECT id // 1024 AS page, count(*) AS n FROM a GROUP BY 1")
def bitset_pages(spark, sf_dir):
    return bitset.page_counts(order_sets(spark, sf_dir)[0])


@query(f"{SETS_SQL} SELECT c_custkey AS id, c_custkey IN (SELECT id FROM a) AS present FROM customer")
def bitset_contains(spark, sf_dir):
    return bitset.contains(order_sets(spark, sf_dir)[0], table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query(f"WITH {VECTORS_SQL} SELECT vector_id, CAST(len(e) AS INTEGER) AS size, round(list_sum(e), 6) AS total, len(list_filter(e, lambda x: x <> 0)) AS non_zero FROM v")
def vector_text_roundtrip(spark, sf_dir):
    sparse = embeddings(spark, sf_dir).select("vector_id", vectors.dense_to_sparse(F.col("values")).alias("s")).select("vector_id", "s.*")
    columns = [F.col(c) for c in ("vector_id", "size", "indices", "values")]
    lines = sparse.select(vectors.format_form_one(*columns).alias("one"), vectors.format_form_two(*columns).alias("two"))
    back = lines.select(vectors.parse(F.col("one")).alias("a"), vectors.parse(F.col("two")).alias("b")).filter("a = b").select("a.*")
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return back.select("vector_id", "size", F.round(total, 6).alias("total"), F.size("values").cast("long").alias("non_zero"))


@query(f"WITH {VECTORS_SQL} SELECT row_number() OVER (ORDER BY vector_id * 3 + 7) - 1 AS vector_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_unit FROM v")
def renumbered_load(spark, sf_dir):
    v = embeddings(spark, sf_dir).select((F.col("vector_id") * 3 + 7).alias("old_id"), "values")
    out = text.number_rows(v, "old_id")
    return out.select("vector_id", F.round(vectors.normalize(F.col("values"))[0], 6).alias("first_unit"))


@query(f"WITH {VECTORS_SQL} SELECT row_number() OVER (ORDER BY vector_id) - 1 AS new_id, round(e[1], 6) AS first_value FROM v QUALIFY new_id < 150")
def capped_load(spark, sf_dir):
    """The first 150 vectors under new ids: the cap is what a capped load is for."""
    return text.load_capped(embeddings(spark, sf_dir), 150).select(F.col("vector_id").alias("new_id"), F.round(F.col("values")[0], 6).alias("first_value"))


@query(f"""{SCORED_SQL}, tr AS (SELECT a.vector_id AS query_id, b.vector_id AS neighbor_id, list_dot_product(a.e, b.e) AS similarity FROM v a JOIN v b ON b.vector_id % 20 <> 0 WHERE a.vector_id % 20 = 0),
ex AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) <= 10),
ap AS (SELECT * FROM scored WHERE query_id % 20 = 0 AND neighbor_id % 20 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbor_id) <= 10)
SELECT e.query_id, count(a.query_id) / CAST(count(*) AS DOUBLE) AS recall FROM ex e LEFT JOIN ap a ON a.query_id = e.query_id AND a.neighbor_id = e.neighbor_id GROUP BY e.query_id""")
def ann_recall_unindexed_queries(spark, sf_dir):
    """Recall of queries that the index does not hold."""
    v = embeddings(spark, sf_dir)
    stored, asking = v.filter("vector_id % 20 <> 0"), queried(v)
    found = search.lsh_search(stored, index.build_index(stored, angle_family()), K, None, queries=asking, query_index=index.build_index(asking, angle_family()))
    return evaluate.recall(found, search.exact_knn(asking, stored, K))


@query("""WITH a AS (SELECT i, d, (i * 16 + d + 42) & 4294967295 AS x FROM range(1000) r(i), range(16) c(d)),
b AS (SELECT i, d, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM a), c AS (SELECT i, d, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM b),
n AS (SELECT i, d FROM c WHERE xor(x >> 16, x) % 1048576 >= CAST(trunc(0.7 * 1048576) AS BIGINT))
SELECT CAST(r.i AS BIGINT) AS vector_id, CAST(16 AS INTEGER) AS size, coalesce(string_agg(CAST(d AS VARCHAR), ',' ORDER BY d), '') AS indices, CAST(count(d) AS DOUBLE) AS total
FROM range(1000) r(i) LEFT JOIN n ON n.i = r.i GROUP BY r.i""")
def synthetic_sparse_vectors(spark, sf_dir):
    s = text.synthetic(spark, 1000, 16, 0.7)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return s.filter(vectors.valid(F.col("size"), F.col("indices"), F.col("values"))).select("vector_id", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), total.alias("total"))
