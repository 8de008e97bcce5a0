"""Queries over forms, files and loads of vectors, and over whole collections, with their SQL twins."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from simloom.config import Config
from simloom.functions import hashing, similarity, vectors
from simloom.operators import adaptive, index, kv
from simloom.operators.families import HashFamily, make_family, save_family
from simloom.plans import vector_queries as base
from simloom.plans.vector_queries import ANGLE_SQL, ORACLES, VECTORS_SQL, embeddings, query, table
from simloom.sources import shared, text
from simloom.streaming import online


def sparse(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vector_id", vectors.dense_to_sparse(F.col("values")).alias("s")).select("vector_id", "s.*")


@query("SELECT CAST(vec_id % 4 AS INTEGER) AS folder, CAST(1 AS BIGINT) AS files, count(*) AS vectors, min(vec_id) AS least FROM embeddings GROUP BY 1")
def vector_files_listed(spark, sf_dir):
    """Files of nested folders, found and read by one path."""
    root = shared.scratch_path(spark, "files")
    rows = sparse(spark, sf_dir).select("vector_id", vectors.format_form_one(*[F.col(c) for c in ("vector_id", "size", "indices", "values")]).alias("value"))
    rows.withColumn("folder", (F.col("vector_id") % 4).cast("int")).drop("vector_id").repartition(4, "folder").write.partitionBy("folder").text(root)
    folder = lambda path: F.regexp_extract(path, "folder=(\\d+)", 1).cast("int").alias("folder")
    files = text.list_files(spark, root).filter("length > 0").select(folder(F.col("path"))).groupBy("folder").agg(F.count("*").alias("files"))
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(folder(F.input_file_name()), vectors.parse(F.col("value"))["vector_id"].alias("vector_id"))
    return files.join(lines.groupBy("folder").agg(F.count("*").alias("vectors"), F.min("vector_id").cast("long").alias("least")), "folder")


@query(f"WITH {VECTORS_SQL} SELECT vector_id, CAST(unnest(range(len(e))) AS INTEGER) AS dimension, unnest(e) AS value FROM v")
def vector_dense_materialized(spark, sf_dir):
    dense = sparse(spark, sf_dir).select("vector_id", vectors.to_dense(F.col("size"), F.col("indices"), F.col("values")).alias("d"))
    return dense.select("vector_id", F.posexplode("d").alias("dimension", "value"))


@query(f"""WITH {VECTORS_SQL} SELECT vector_id, CAST(len(e) AS INTEGER) AS size, CAST(0 AS INTEGER) AS first_index, round(e[len(e)], 6) AS last_value, round(list_sum(e), 6) AS total, CAST(0 AS DOUBLE) AS zero_total FROM v""")
def vector_factories(spark, sf_dir):
    """Vectors made from pairs in falling order, and vectors of zeros."""
    pairs = F.reverse(F.transform("values", lambda x, k: F.struct(k.alias("i"), x.alias("v"))))
    made = embeddings(spark, sf_dir).select("vector_id", vectors.from_pairs(F.size("values"), pairs).alias("s"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return made.select(
        "vector_id", "s.size", F.col("s.indices")[0].alias("first_index"), F.round(F.element_at("s.values", -1), 6).alias("last_value"), F.round(add(F.col("s.values")), 6).alias("total"), add(vectors.zeros(16)).alias("zero_total")
    )


@query(f"WITH {VECTORS_SQL} SELECT a.vector_id, true AS own_forms, b.e IS NOT NULL AND a.e = b.e AS like_next, round(list_sum(a.e), 6) AS total FROM v a LEFT JOIN v b ON b.vector_id = a.vector_id + 1")
def vector_forms_agree(spark, sf_dir):
    """Dense vectors against both text forms and the sparse form of themselves, and against the next vector."""
    v = embeddings(spark, sf_dir)
    rows = v.select("vector_id", "values", vectors.dense_to_sparse(F.col("values")).alias("s"))
    args = [F.col("vector_id"), F.col("s.size"), F.col("s.indices"), F.col("s.values")]
    forms = {"one": vectors.parse(vectors.format_form_one(*args)), "two": vectors.parse(vectors.format_form_two(*args)), "three": F.col("s")}
    rows = shared.cut(rows.select("vector_id", "values", *[x.alias(c) for c, x in forms.items()]))  # parsed once, not once a component
    own = F.lit(True)
    for c in forms:
        own &= vectors.same_vector(F.col("values"), vectors.to_dense(F.col(f"{c}.size"), F.col(f"{c}.indices"), F.col(f"{c}.values")))
    following = v.select((F.col("vector_id") - 1).alias("vector_id"), F.col("values").alias("next_values"))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("own_forms", own).join(following, "vector_id", "left").select(
        "vector_id", "own_forms", vectors.same_vector(F.col("values"), F.col("next_values")).alias("like_next"), F.round(total, 6).alias("total")
    )


def from_file(spark, sf_dir, made, **settings):
    """The index of a family that was written as text and read back."""
    path = shared.scratch_path(spark, "functions")
    save_family(spark, made, path)
    if settings["family"] == "precalculated":
        save_family(spark, made.halves, path + "-halves")
        path = f"{path},{path}-halves"
    read = make_family(Config(method="fromfile", family_file=path, tables=made.tables, dim=made.dim, **settings), spark)
    return index.build_index(embeddings(spark, sf_dir), read)


@query(ORACLES["angle_bucket_keys"])
def angle_family_from_file(spark, sf_dir):
    return from_file(spark, sf_dir, base.angle_family(), family="angle", chain_length=base.CHAIN)


@query(ORACLES["pstable_bucket_keys"])
def pstable_family_from_file(spark, sf_dir):
    return from_file(spark, sf_dir, base.pstable_family(), family="pStable", chain_length=4)


@query(ORACLES["precalc_bucket_keys"])
def precalculated_family_from_file(spark, sf_dir):
    return from_file(spark, sf_dir, base.precalculated_family(), family="precalculated", chain_length=6)


class FirstComponents(HashFamily):
    """A hasher of one's own: table t has the bucket floor(1000 x) of component t."""

    def __init__(self, tables: int, dim: int):
        self.tables, self.dim = tables, dim

    def keys(self, x):
        return np.floor(1000 * x[:, : self.tables]).astype(np.int32)

    def key_expression(self, values, table):
        return F.floor(values[table] * 1000).cast("int")

    def lines(self):
        return [str(t) for t in range(self.tables)]


@query(f"WITH {VECTORS_SQL} SELECT vector_id, CAST(t AS INTEGER) AS table_id, CAST(floor(1000 * e[t + 1]) AS INTEGER) AS bucket_key FROM v, range(3) r(t)")
def own_hasher_keys(spark, sf_dir):
    return index.build_index(embeddings(spark, sf_dir), FirstComponents(3, base.DIM))


@query(f"{ANGLE_SQL} SELECT table_id, bucket_key, vector_id FROM k")
def index_written_and_read(spark, sf_dir):
    """The initial load: every table written at once, each in a folder of its own."""
    path = shared.scratch_path(spark, "index")
    index.write_index(base.angle_index(spark, sf_dir), path)
    return spark.read.parquet(path).select("table_id", "bucket_key", "vector_id")


@query(f"{ANGLE_SQL} SELECT table_id, bucket_key, vector_id FROM k WHERE vector_id < 100 OR table_id IN (1, 3)")
def index_of_allocated_tables(spark, sf_dir):
    """An index of the first vectors that takes later ones for two of its tables."""
    i = base.angle_index(spark, sf_dir)
    return online.insert_allocated(i.filter("vector_id < 100"), i.filter("vector_id >= 100"), [1, 3])


WIDE = adaptive.Geometry(bucket_bits=24, directory_size=16, hash_bits=32, overflow=6)


@query(base.leaves_sql(WIDE) + " SELECT * FROM leaves")
def adaptive_wide_geometry(spark, sf_dir):
    return adaptive.assign_leaves(index.build_index(embeddings(spark, sf_dir), base.deep_family()), WIDE)


@query("SELECT 'whole' AS state, count(*) AS n, count(*) = 0 AS is_empty FROM orders UNION ALL SELECT 'cleared' AS state, count(*) AS n, count(*) = 0 AS is_empty FROM orders WHERE false")
def kv_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    named = [kv.size(df).select(F.lit(state).alias("state"), "n", "is_empty") for state, df in (("whole", o), ("cleared", kv.clear(o)))]
    return named[0].unionByName(named[1])


@query("SELECT s AS value, s IN (SELECT c_mktsegment FROM customer) AS present FROM (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) t(s)")
def kv_contains_value(spark, sf_dir):
    wanted = spark.createDataFrame([("BUILDING",), ("MACHINERY",), ("NONE",)], "value string")
    return kv.contains_key(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), wanted, "value")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, (xor(o_orderkey >> 16, o_orderkey) * 73244475) & 4294967295 AS x FROM orders), b AS (SELECT o_orderkey, o_custkey, (xor(x >> 16, x) * 73244475) & 4294967295 AS x FROM a),
h AS (SELECT o_orderkey, o_custkey, xor(x >> 16, x) AS h FROM b)
SELECT CAST(h % 8 AS INTEGER) AS part, row_number() OVER (PARTITION BY h % 8 ORDER BY h, o_orderkey) - 1 AS position, o_orderkey, o_custkey FROM h""")
def kv_partition_view(spark, sf_dir):
    """Entries of each partition in the order of their hashes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", hashing.scramble(F.col("o_orderkey")).alias("h"))
    placed = rows.withColumn("part", index.hash_partition(F.col("h"), 8))
    return text.running_total(placed, ["part"], [F.col("h"), F.col("o_orderkey")], F.lit(1), "position").drop("h")


@query("SELECT 'before' AS version, c_custkey, c_acctbal FROM customer UNION ALL SELECT 'after' AS version, c_custkey, c_acctbal * 2 AS c_acctbal FROM customer")
def kv_snapshot(spark, sf_dir):
    """A snapshot beside what a later commit made of the collection."""
    catalog, path = kv.Catalog(spark, f"simloom_{uuid.uuid4().hex}_"), shared.scratch_path(spark, "snapshot")
    catalog.create("a", table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    before = catalog.snapshot("a")
    catalog.commit("a", catalog.get("a").withColumn("c_acctbal", F.col("c_acctbal") * 2))
    named = lambda df, version: df.select(F.lit(version).alias("version"), "c_custkey", "c_acctbal")
    named(before, "before").unionByName(named(catalog.get("a"), "after")).write.parquet(path)
    catalog.drop("a")
    return spark.read.parquet(path)


@query("""SELECT 'clients' AS name, count(*) AS n FROM customer UNION ALL SELECT 'parts' AS name, count(*) AS n FROM part""")
def kv_catalog_names(spark, sf_dir):
    """Three collections are made, one is renamed, one is dropped."""
    catalog = kv.Catalog(spark, f"simloom_{uuid.uuid4().hex}_")
    for name, source in (("customers", "customer"), ("parts", "part"), ("gone", "nation")):
        catalog.create(name, table(spark, sf_dir, source))
    catalog.rename("customers", "clients")
    catalog.drop("gone")
    found = [(name, catalog.get(name).count()) for name in catalog.names()]
    for name, _ in found:
        catalog.drop(name)
    return spark.createDataFrame(found, "name string, n long")


@query("""SELECT user_id, CAST(sum(event_id) AS BIGINT) AS total, max(event_id) AS greatest, bool_or(value > 50) AS any_large, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def kv_atomics(spark, sf_dir):
    """A sum, a maximum, a flag and a last value for each key, combined before the shuffle."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.sum("event_id").alias("total"), F.max("event_id").alias("greatest"), F.bool_or(F.col("value") > 50).alias("any_large"), F.max_by("event_type", "event_id").alias("last_type"))


@query("SELECT l_suppkey % 5 AS k, l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY [l_suppkey % 5, -l_orderkey, l_linenumber, l_partkey]) - 1 AS position FROM lineitem")
def kv_array_order(spark, sf_dir):
    """Positions in the order of arrays, component by component."""
    key = F.array(F.col("l_suppkey") % 5, -F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), "l_orderkey", "l_linenumber", "l_partkey", key.alias("key"))
    return kv.ordered(rows, [F.col("key")]).drop("key")


@query(f"WITH {VECTORS_SQL} SELECT a.vector_id, round(list_dot_product(a.e, b.e), 6) AS sparse_dot FROM v a JOIN v b ON b.vector_id = a.vector_id + 1")
def sparse_dot_pairs(spark, sf_dir):
    a = sparse(spark, sf_dir)
    b = a.select((F.col("vector_id") - 1).alias("vector_id"), F.col("indices").alias("j"), F.col("values").alias("w"))
    return a.join(b, "vector_id").select("vector_id", F.round(similarity.sparse_dot(F.col("indices"), F.col("values"), F.col("j"), F.col("w")), 6).alias("sparse_dot"))
