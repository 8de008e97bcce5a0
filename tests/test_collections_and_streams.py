import pytest
from pyspark.sql import functions as F

from simloom.operators import bitset, kv
from simloom.operators.families import AngleFamily, scrambled_planes
from simloom.sources import text
from simloom.streaming import online


def pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


def test_updates(spark):
    base = table(spark, [(1, "a"), (2, "b")])
    rows = table(spark, [(2, "B"), (3, "C")])
    assert pairs(kv.upsert(base, rows, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert pairs(kv.put_if_absent(base, rows, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert pairs(kv.remove(base, rows, ["k"])) == [(1, "a")]
    assert pairs(kv.remove(base, rows, ["k"], ["v"])) == [(1, "a"), (2, "b")]
    assert pairs(kv.replace(base, rows, ["k"], "v")) == [(1, "a"), (2, "B")]
    both = table(spark, [(1, "X", "a"), (2, "Y", "no")], "k long, new string, old string")
    assert pairs(kv.replace(base, both, ["k"], "v", "new", "old")) == [(1, "X"), (2, "b")]
    assert pairs(kv.latest(table(spark, [(1, "a", 1), (1, "z", 0)], "k long, v string, n int"), ["k"], "n")) == [(1, "a", 1)]
    assert kv.contains_value(base, "v", "a") and not kv.contains_value(base, "v", "q")


def test_navigation_against_a_sorted_list(spark):
    keys, probes = [3, 10, 11, 250, 990], [0, 3, 4, 11, 12, 500, 990, 2000]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.p: r for r in kv.navigate(spark.createDataFrame([(p,) for p in probes], "p long"), "p", df, "k").collect()}
    for p in probes:
        want = (max((k for k in keys if k <= p), default=None), max((k for k in keys if k < p), default=None), min((k for k in keys if k >= p), default=None), min((k for k in keys if k > p), default=None))
        assert (got[p].floor, got[p].lower, got[p].ceiling, got[p].higher) == want


def test_navigation_reads_a_range_once(spark, capsys):
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    found = kv.navigate(spark.range(-2, 3010).withColumnRenamed("id", "p"), "p", df, "k")
    for r in found.collect():
        assert r.floor == (None if r.p < 0 else min(r.p // 3 * 3, 2997)) and r.higher == (None if r.p >= 2997 else max(r.p // 3 * 3 + 3, 0))
    found.explain("formatted")
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_queues_and_uniqueness(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    take = lambda kind: [r.n for r in sorted(kv.queue(df, "n", 3, kind).collect(), key=lambda r: r.position)]
    assert (take("fifo"), take("lifo"), take("circular")) == ([0, 1, 2], [9, 8, 7], [7, 8, 9])
    assert kv.checked_unique(df, ["n"]).count() == 10
    with pytest.raises(Exception, match="occurs twice"):
        kv.checked_unique(df.union(df), ["n"]).collect()


def test_eviction_splits_a_collection(spark):
    df = spark.range(20).withColumnRenamed("id", "n")
    assert {r.n for r in kv.keep_newest(df, 5, "n").collect()} | {r.n for r in kv.evicted(df, 5, "n", "n").collect()} == set(range(20))


def test_catalog(spark):
    c = kv.Catalog(spark, "t_")
    c.create("a", table(spark, [(1, "x")]))
    c.commit("a", kv.upsert(c.get("a"), table(spark, [(2, "y")]), ["k"]))
    assert pairs(c.get("a")) == [(1, "x"), (2, "y")] and c.exists("a") and c.names() == ["a"]
    c.rename("a", "b")
    c.drop("b")
    assert c.names() == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("t_")]


def test_transactions(spark):
    c = kv.Catalog(spark, "tx_")
    c.create("a", table(spark, [(1, "x")]))
    one, two = c.begin("a"), c.begin("a")
    one.write(kv.upsert(one.read(), table(spark, [(2, "y")]), ["k"]))
    assert pairs(c.get("a")) == [(1, "x")]
    one.commit()
    two.write(table(spark, [(9, "late")]))
    with pytest.raises(kv.Conflict):
        two.commit()
    assert pairs(c.get("a")) == [(1, "x"), (2, "y")]
    two.rollback()
    assert pairs(two.read()) == [(1, "x"), (2, "y")]
    old = c.snapshot("a")
    c.commit("a", table(spark, [(5, "z")]))
    assert pairs(old) == [(1, "x"), (2, "y")] and pairs(c.get("a")) == [(5, "z")]
    c.rollback("a")
    assert pairs(c.get("a")) == [(1, "x"), (2, "y")]
    c.compact("a")
    assert pairs(c.get("a")) == [(1, "x"), (2, "y")]
    c.drop("a")


def test_a_name_is_never_without_a_table(spark, monkeypatch):
    c = kv.Catalog(spark, "cut_")
    c.create("a", table(spark, [(1, "x")]))

    def fail(*args):
        raise RuntimeError("gone")

    monkeypatch.setattr(c, "_point", fail)
    with pytest.raises(RuntimeError):
        c.commit("a", table(spark, [(2, "y")]))
    assert pairs(c.get("a")) == [(1, "x")]


def test_bulk_loads(spark):
    rows = table(spark, [(1, "b"), (1, "a"), (2, "c")])
    assert pairs(kv.bulk_load(rows, ["k"], "v", duplicates="ignore")) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="occurs twice"):
        kv.bulk_load(rows, ["k"]).collect()
    with pytest.raises(ValueError):
        kv.bulk_load(rows, ["k"], duplicates="no such")


def test_arrays_have_a_bound(spark):
    rows = table(spark, [(1, "b"), (1, "a"), (2, "c")])
    assert pairs(kv.multi_get(rows, ["k"], "v", most=2)) == [(1, ["a", "b"]), (2, ["c"])]
    with pytest.raises(ValueError):
        kv.multi_get(rows, ["k"], "v", most=1)
    assert kv.multi_get(rows, ["k"], "v").count() == 3


def test_a_collection_spills_where_it_is_read(spark, tmp_path):
    store = text.SpilledCollection(spark, str(tmp_path), "k", 2)
    store.put(table(spark, [(1, "a"), (2, "b")]))
    assert sorted(map(tuple, store.lookup([1, 2]).collect())) == [(1, "a", 1), (2, "b", 1)] and store.generations == 1
    store.put(table(spark, [(1, "c")]))
    assert sorted(map(tuple, store.lookup([1, 3]).collect())) == [(1, "a", 1), (1, "c", 0)] and store.generations == 1
    assert pairs(store.latest([1, 2])) == [(1, "c"), (2, "b")]
    store.put(table(spark, [(2, "d")]))
    assert sorted(map(tuple, store.lookup([1, 2]).collect())) == [(1, "a", 2), (1, "c", 1), (2, "b", 2), (2, "d", 1)] and store.memory is None


def test_size_and_access_expire(spark):
    df = spark.createDataFrame([(k, 10 * k) for k in range(1, 6)], "n long, size long")
    assert sorted(r.n for r in kv.keep_within_size(df, F.col("size"), 95, [F.desc("n")]).collect()) == [4, 5]
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (3, "2024-01-01 09:59:30")], "k long, w string").withColumn("w", F.to_timestamp("w"))
    reads = spark.createDataFrame([(1, "2024-01-01 09:59:00"), (2, "2024-01-01 08:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    got = kv.expire_after_access(rows, "k", "w", reads, "t", 60, F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    assert sorted(r.k for r in got.collect()) == [1, 3]


def test_bitsets(spark):
    of = lambda *ids: bitset.words(spark.createDataFrame([(i,) for i in ids], "id long"))
    ids = lambda b: sorted(r.id for r in bitset.members(b).collect())
    assert bitset.page_counts(of(1, 1024, 1025, 2048)).count() == 3
    assert ids(bitset.intersection(of(1, 1025), of(1025, 3))) == [1025]
    assert ids(bitset.union(of(1, 2048), of(1, 1025))) == [1, 1025, 2048]
    assert ids(bitset.difference(of(1, 63, 64), of(63))) == [1, 64]
    assert ids(bitset.flip(of(*range(1, 1024)))) == [0]
    there = bitset.contains(of(0, 63, 4095), spark.createDataFrame([(i,) for i in (0, 1, 63, 4095, 9999)], "id long"))
    assert {r.id for r in there.filter("present").collect()} == {0, 63, 4095}


def state(spark, root, **options):
    return online.OnlineIndex(spark, AngleFamily(scrambled_planes(2, 3, 3)), str(root), **options)


def batch(spark, *ids):
    return spark.createDataFrame([(i, [0.1, 0.2, 0.0]) for i in ids], online.VECTOR)


def answers(s):
    return sorted((r.query_id, r.neighbor_id) for r in s.results().collect())


def test_online_index_answers_then_inserts(spark, tmp_path):
    s = state(spark, tmp_path)
    s.process(batch(spark, 1), 0)
    s.process(batch(spark, 2, 3), 1)
    assert answers(s) == [(2, 1), (3, 1), (3, 2)]
    s.process(batch(spark, 2, 3), 1)  # the batch runs again
    assert answers(s) == [(2, 1), (3, 1), (3, 2)] and s.index().count() == 6


def test_merging_changes_no_answer(spark, tmp_path):
    s = state(spark, tmp_path, merge_threshold=2)
    for k in range(4):
        s.process(batch(spark, k), k)
    assert answers(s) == [(a, b) for a in range(4) for b in range(a)]
    assert s.delta_size() == 0 and s.index().count() == 8


def test_a_batch_that_runs_again_after_a_merge_finds_the_same(spark, tmp_path):
    s = state(spark, tmp_path, merge_threshold=2)
    for k in range(3):
        s.process(batch(spark, 2 * k, 2 * k + 1), k)
        before = answers(s)
        for again in {0, k}:
            s.process(batch(spark, 2 * again, 2 * again + 1), again)
            assert answers(s) == before == [(a, b) for a in range(2 * k + 2) for b in range(a)]
    assert s.vectors().count() == 6 and s.index().count() == 12


def test_a_merge_cut_short_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    s = state(spark, tmp_path, merge_threshold=2)
    s.process(batch(spark, 0), 0)

    def fail(*args):
        raise RuntimeError("gone")

    with monkeypatch.context() as m:
        m.setattr(online.shared, "discard", fail)
        with pytest.raises(RuntimeError):
            s.process(batch(spark, 1), 1)
    s.process(batch(spark, 1), 1)
    s.process(batch(spark, 2, 3), 2)
    assert answers(s) == [(a, b) for a in range(4) for b in range(a)] and s.index().count() == 8


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:05:00", 1.0), ("a", "2024-01-01 00:20:00", 3.0), ("a", "2024-01-01 02:00:00", 2.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in online.sessions(rows, "t", "k").collect()) == [1, 2]
    assert sorted(r.n for r in online.sliding_windows(rows, "t", "v").collect()) == [1, 1, 2, 2]


def test_tables_that_a_worker_has(spark):
    rows = spark.createDataFrame([(t, 7, v) for t in range(3) for v in (1, 2)], online.INDEX)
    got = online.insert_allocated(rows.filter("vector_id = 1 AND table_id = 0"), rows, [0, 2])
    assert pairs(got) == [(0, 7, 1), (0, 7, 2), (2, 7, 1), (2, 7, 2)]


def test_generations(spark):
    df = spark.range(12)
    got = [r.g for r in df.select(online.generation(F.col("id"), 2, 3).alias("g")).collect()]
    assert got == [0, 0, 1, 1, 2, 2] * 2
    assert sorted(r.id for r in online.live_generations(df, "id", 2, 3).collect()) == list(range(6, 12))
    inside = lambda lo, hi: [r.id for r in spark.range(4).filter(online.in_window(F.col("id"), lo, hi)).collect()]
    assert inside(0, 0) == [0] and inside(1, 2) == [1, 2] and inside(3, 0) == [0, 3]


def test_change_feed(spark):
    got = pairs(kv.changes(table(spark, [(1, "a"), (2, "b"), (3, None)]), table(spark, [(2, "B"), (3, None), (4, "d")]), ["k"], "v"))
    assert got == [(1, "delete", "a", None), (2, "update", "b", "B"), (4, "insert", None, "d")]
