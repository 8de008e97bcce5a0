"""Queries over keyed collections and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from simloom.operators import index, kv
from simloom.plans.vector_queries import ANGLE_SQL, THEN_INSERT_SQL, THRESHOLD, angle_family, embeddings, query, table
from simloom.sources import shared, text
from simloom.streaming import online


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 100, 1000, 5000, 999999999)")
def kv_point_get(spark, sf_dir):
    return kv.get(orders(spark, sf_dir), "o_orderkey", [1, 7, 100, 1000, 5000, 999999999]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS present FROM customer")
def kv_contains_key(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return kv.contains_key(orders(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey")), keys, "c_custkey")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def kv_upsert_latest(spark, sf_dir):
    return kv.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("""WITH u AS (SELECT c_custkey AS k, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000 AS k, c_acctbal AS v FROM customer WHERE c_custkey % 50 = 0)
SELECT k, v FROM u UNION ALL SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM u)""")
def kv_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    updates = base.filter("k % 3 = 0").withColumn("v", F.col("v") + 1).unionByName(base.filter("k % 50 = 0").withColumn("k", F.col("k") + 10_000_000))
    return kv.upsert(base, updates, ["k"])


@query("""SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 2 <> 0""")
def kv_put_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return kv.put_if_absent(c.filter("k % 2 = 0"), c.withColumn("v", F.lit("new")), ["k"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000))")
def kv_remove(spark, sf_dir):
    gone = orders(spark, sf_dir).filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return kv.remove(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), gone, ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_mktsegment = 'BUILDING')")
def kv_remove_value(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    gone = c.filter("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("BUILDING"))
    return kv.remove(c, gone, ["c_custkey"], ["c_mktsegment"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_mktsegment = 'BUILDING' THEN 'REPLACED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def kv_replace(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = c.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("REPLACED").alias("new"), F.lit("BUILDING").alias("old"))
    return kv.replace(c, rows, ["c_custkey"], "c_mktsegment", "new", "old")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def kv_range_scan(spark, sf_dir):
    return kv.range_scan(orders(spark, sf_dir), "o_orderkey", 100, 5000).select("o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS position, o_orderkey, o_totalprice FROM orders")
def kv_descending(spark, sf_dir):
    return kv.descending(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), "o_orderkey").select("position", "o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_totalprice DESC, o_orderkey) - 1 AS position, o_custkey, o_totalprice, o_orderkey FROM orders")
def kv_composite_order(spark, sf_dir):
    by = [F.asc("o_custkey"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return kv.ordered(orders(spark, sf_dir).select("o_custkey", "o_totalprice", "o_orderkey"), by).select("position", "o_custkey", "o_totalprice", "o_orderkey")


@query("SELECT * FROM (SELECT 'first' AS which, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3) UNION ALL SELECT * FROM (SELECT 'last' AS which, o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 3)")
def kv_poll_first_last(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey")
    ends = [kv.poll(o, "o_orderkey", last, 3).select(F.lit(name).alias("which"), "o_orderkey") for name, last in (("first", False), ("last", True))]
    return ends[0].unionByName(ends[1])


@query("""WITH p AS (SELECT DISTINCT p_partkey * 37 AS probe FROM part), k AS (SELECT DISTINCT o_custkey * 10 AS key FROM orders),
f AS (SELECT probe, key AS floor FROM p ASOF LEFT JOIN k ON p.probe >= k.key), l AS (SELECT probe, key AS lower FROM p ASOF LEFT JOIN k ON p.probe > k.key),
c AS (SELECT probe, key AS ceiling FROM p ASOF LEFT JOIN k ON p.probe <= k.key), h AS (SELECT probe, key AS higher FROM p ASOF LEFT JOIN k ON p.probe < k.key)
SELECT probe, coalesce(floor, -1) AS floor, coalesce(lower, -1) AS lower, coalesce(ceiling, -1) AS ceiling, coalesce(higher, -1) AS higher FROM f JOIN l USING (probe) JOIN c USING (probe) JOIN h USING (probe)""")
def kv_floor_ceiling(spark, sf_dir):
    probes = table(spark, sf_dir, "part").select((F.col("p_partkey") * 37).alias("probe")).distinct()
    keys = orders(spark, sf_dir).select((F.col("o_custkey") * 10).alias("key"))
    found = kv.navigate(probes, "probe", keys, "key")
    return found.select("probe", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("floor", "lower", "ceiling", "higher")])


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) AS all_values FROM lineitem GROUP BY l_orderkey")
def kv_multi_get(spark, sf_dir):
    return kv.multi_get(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", most=1000)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def kv_prefix_filter(spark, sf_dir):
    return kv.prefix_filter(table(spark, sf_dir, "lineitem"), l_returnflag="R", l_linestatus="F").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_mktsegment AS secondary_key, c_custkey FROM customer")
def kv_secondary_key(spark, sf_dir):
    return kv.secondary_key(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_mktsegment"))


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS secondary_key, p_partkey FROM part")
def kv_secondary_keys_many(spark, sf_dir):
    return kv.secondary_key(table(spark, sf_dir, "part"), "p_partkey", F.split("p_type", " "))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS secondary_value FROM part")
def kv_secondary_values(spark, sf_dir):
    return kv.secondary_values(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "))


@query("SELECT n_name, n_nationkey FROM nation")
def kv_inverse(spark, sf_dir):
    return kv.inverse(table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def kv_histogram(spark, sf_dir):
    return kv.histogram(events(spark, sf_dir), F.col("event_type"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END, 'MADE-' || o_orderkey) AS v FROM orders")
def kv_value_on_miss(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority"))
    o = orders(spark, sf_dir).select("o_orderkey", v.alias("v"))
    return kv.value_on_miss(o, "v", F.concat(F.lit("MADE-"), F.col("o_orderkey").cast("string")))


@query("SELECT event_id, user_id FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 86400 * CAST(1000000 AS BIGINT)")
def kv_expire_ttl(spark, sf_dir):
    return kv.expire_after(events(spark, sf_dir), "ts", 86_400).select("event_id", "user_id")


@query("SELECT epoch_us(min(ts)) + 60000000 AS first_us, epoch_us(max(ts)) + 60000000 AS last_us FROM events")
def kv_expiry_bounds(spark, sf_dir):
    return kv.expiry_bounds(events(spark, sf_dir), "ts", 60).select(F.unix_micros(F.col("first_expiry").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_expiry").cast("timestamp")).alias("last_us"))


@query("""WITH w AS (SELECT user_id, min(ts) AS written, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, epoch_us(written) AS written_us FROM w WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(last) <= 86400 * CAST(1000000 AS BIGINT)""")
def kv_expire_after_access(spark, sf_dir):
    e = events(spark, sf_dir)
    entries = e.groupBy("user_id").agg(F.min("ts").alias("written"))
    now = F.lit(e.agg(F.max("ts")).first()[0])
    out = kv.expire_after_access(entries, "user_id", "written", e.select("user_id", "ts"), "ts", 86_400, now)
    return out.select("user_id", F.unix_micros(F.col("written").cast("timestamp")).alias("written_us"))


@query("SELECT o_orderkey, o_orderpriority FROM orders QUALIFY sum(length(o_orderpriority)) OVER (ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) <= 20000")
def kv_expire_store_size(spark, sf_dir):
    return kv.keep_within_size(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), F.length("o_orderpriority"), 20_000, [F.desc("o_orderkey")])


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def kv_expire_max_size(spark, sf_dir):
    return kv.keep_newest(events(spark, sf_dir).select("event_id", "user_id", "ts"), 500, "ts", "event_id").drop("ts")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def kv_evict_overflow(spark, sf_dir):
    return kv.evicted(events(spark, sf_dir).select("event_id", "user_id", "ts"), 500, "event_id", "ts", "event_id").drop("ts")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def kv_sort_merge_dedup(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_type", "event_id")
    return kv.sort_merge([e.filter("event_id % 2 = 0"), e.filter("event_id % 2 <> 0")], ["user_id", "event_type"], "event_id")


@query("SELECT DISTINCT o_custkey FROM orders")
def kv_hash_set(spark, sf_dir):
    return orders(spark, sf_dir).select("o_custkey").distinct()


@query("SELECT count(*) AS n, sum(CAST(o_totalprice > 200000 AS INTEGER)) > 0 AS any_large, max(o_orderkey) AS last_key FROM orders")
def kv_counters(spark, sf_dir):
    return orders(spark, sf_dir).agg(F.count("*").alias("n"), (F.count_if(F.col("o_totalprice") > 200000) > 0).alias("any_large"), F.max("o_orderkey").alias("last_key"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'delete' WHEN c_custkey % 5 = 0 THEN 'insert' ELSE 'update' END AS change,
  CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 <> 0 THEN NULL ELSE c_mktsegment END AS old_value, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS new_value
FROM customer WHERE (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) OR (c_custkey % 5 = 0 AND c_custkey % 7 <> 0) OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)""")
def kv_change_feed(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    changed = F.when(F.col("c_custkey") % 3 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))
    return kv.changes(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 7 <> 0").withColumn("c_mktsegment", changed), ["c_custkey"], "c_mktsegment")


@query("SELECT c_custkey AS k, 'c' AS source FROM customer UNION ALL SELECT s_suppkey AS k, 's' AS source FROM supplier")
def kv_merge_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("source"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("source")))


for kind, name, by, place in (("fifo", "queue_fifo", "event_id", "event_id"), ("lifo", "stack_lifo", "event_id DESC", "event_id DESC"), ("circular", "circular_last_n", "event_id DESC", "event_id")):

    def take(spark, sf_dir, kind=kind):
        return kv.queue(events(spark, sf_dir).select("event_id", "event_type"), "event_id", 50, kind)

    take.__name__ = name
    query(f"SELECT event_id, event_type, row_number() OVER (ORDER BY {place}) - 1 AS position FROM (SELECT event_id, event_type FROM events ORDER BY {by} LIMIT 50)")(take)


@query("SELECT o_orderkey, o_custkey FROM orders")
def kv_checked_bulk_load(spark, sf_dir):
    return kv.checked_unique(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1")
def kv_bulk_load_ignoring(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return kv.bulk_load(rows, ["l_orderkey"], "l_linenumber", "l_partkey", duplicates="ignore")


def spilled_orders(spark, sf_dir):
    """Orders in a collection that spills at every read, put in by thirds of their keys."""
    o = orders(spark, sf_dir).select("o_custkey", "o_orderkey")
    third = F.floor(F.col("o_orderkey") * 3 / (o.agg(F.max("o_orderkey")).first()[0] + 1))
    store = text.SpilledCollection(spark, shared.scratch_path(spark, "spilled"), "o_custkey", 1)
    for k in range(2):
        store.put(o.filter(third == k))
        store.maybe_spill()
    store.threshold = 1 << 40
    store.put(o.filter(third == 2))
    return store


SPILLED_SQL = "WITH s AS (SELECT o_custkey, o_orderkey, 2 - CAST(floor(o_orderkey * 3 / (SELECT max(o_orderkey) + 1 FROM orders)) AS INTEGER) AS age FROM orders WHERE o_custkey IN (1, 4, 7, 10, 11, 100, 1000, 99999999))"


@query(f"{SPILLED_SQL} SELECT * FROM s")
def spilled_lookup(spark, sf_dir):
    return spilled_orders(spark, sf_dir).lookup([1, 4, 7, 10, 11, 100, 1000, 99_999_999])


@query("""WITH t AS (SELECT c_custkey, c_acctbal FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM t""")
def kv_transactions(spark, sf_dir):
    """A commit that holds, one that is rolled back, and one that another came before."""
    catalog, name = kv.Catalog(spark, f"simloom_{uuid.uuid4().hex}_"), "accounts"
    catalog.create(name, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    raised = lambda df, by: df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + by).otherwise(F.col("c_acctbal")))
    late, first = catalog.begin(name), catalog.begin(name)
    first.write(raised(first.read(), 10))
    first.commit()
    late.write(raised(late.read(), 1000))
    try:
        late.commit()
    except kv.Conflict:
        late.rollback()
    catalog.commit(name, raised(catalog.get(name), 500))
    catalog.rollback(name)
    path = shared.scratch_path(spark, "accounts")
    catalog.get(name).write.parquet(path)
    catalog.drop(name)
    return spark.read.parquet(path)


@query(f"""{ANGLE_SQL}, o AS (SELECT *, CAST((vector_id // 50) % 4 AS INTEGER) AS generation FROM k)
SELECT table_id, bucket_key, vector_id, generation, generation BETWEEN 1 AND 2 AS in_window, (CAST(bucket_key AS BIGINT) % 3 + 3) % 3 = vector_id % 3 AS owned FROM o""")
def generation_ring(spark, sf_dir):
    i = index.build_index(embeddings(spark, sf_dir), angle_family())
    g = online.generation(F.col("vector_id"), 50, 4)
    return i.select("table_id", "bucket_key", "vector_id", g.alias("generation"), online.in_window(g, 1, 2).alias("in_window"), online.owned(F.col("bucket_key"), F.col("vector_id"), 3).alias("owned"))


@query("""WITH g AS (SELECT vec_id AS vector_id, CAST((vec_id // 50) % 4 AS INTEGER) AS generation, vec_id // 200 AS r FROM embeddings)
SELECT vector_id, generation FROM g QUALIFY r = max(r) OVER (PARTITION BY generation)""")
def generation_retired(spark, sf_dir):
    return online.live_generations(embeddings(spark, sf_dir).select("vector_id"), "vector_id", 50, 4).select("vector_id", "generation")


def streamed(spark, sf_dir, merge_threshold: int):
    """An online index that has read all embeddings as a stream of four files in order."""
    root = shared.scratch_path(spark, "stream")
    v = embeddings(spark, sf_dir)
    bounds = v.agg(F.min("vector_id"), F.max("vector_id")).first()
    step = (bounds[1] - bounds[0]) // 4 + 1
    for k in range(4):
        part = v.filter((F.col("vector_id") >= bounds[0] + k * step) & (F.col("vector_id") < bounds[0] + (k + 1) * step))
        part.coalesce(1).write.mode("append").parquet(f"{root}/input")
    state = online.OnlineIndex(spark, angle_family(), f"{root}/state", THRESHOLD, merge_threshold=merge_threshold)
    run = state.start(online.vector_stream(spark, f"{root}/input", vector_type="array<double>", vector_id="vector_id", values="values"), f"{root}/checkpoint")
    run.awaitTermination()
    return state


@query(THEN_INSERT_SQL)
def stream_search_then_insert(spark, sf_dir):
    return streamed(spark, sf_dir, 10**9).results().withColumn("similarity", F.round("similarity", 6))


@query(THEN_INSERT_SQL)
def stream_compaction(spark, sf_dir):
    return streamed(spark, sf_dir, 100).results().withColumn("similarity", F.round("similarity", 6))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n, max(value) AS max_value, min(value) AS min_value, round(avg(value), 6) AS avg_value FROM events GROUP BY 1")
def latency_windows(spark, sf_dir):
    out = online.latency_windows(events(spark, sf_dir), "ts", "value", "1 day")
    return out.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", "max_value", "min_value", F.round("avg_value", 6).alias("avg_value"))


@query("""WITH w AS (SELECT event_id, value, ts FROM events WHERE ts IS NOT NULL),
k AS (SELECT epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) AS s, value FROM w UNION ALL SELECT epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) - 43200 * CAST(1000000 AS BIGINT) AS s, value FROM w)
SELECT s AS start_us, count(*) AS n, max(value) AS max_value FROM k GROUP BY s""")
def sliding_windows(spark, sf_dir):
    out = online.sliding_windows(events(spark, sf_dir), "ts", "value", "1 day", "12 hours")
    return out.select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", "max_value")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600 * CAST(1000000 AS BIGINT) THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(t) AS start_us, max(t) + 3600 * CAST(1000000 AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    out = online.sessions(events(spark, sf_dir).filter("user_id IS NOT NULL"), "ts", "user_id", "1 hour")
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")
