import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.functions import similarity, vectors
from simloom.operators import adaptive, blocks, evaluate, index, search
from simloom.operators.families import AngleFamily, scrambled_planes
from simloom.sources import text


def dense(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in rows], "vector_id long, values array<double>")


def test_text_forms(spark):
    lines = ["(3,3,[0,1,2],[1.0,2.0,3.0])", "((3,[0,2],[4.0,6.0]),4)", "(5,3,[],[])", "nonsense"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in lines], "l string").select(vectors.parse(F.col("l")).alias("v")).collect()]
    assert tuple(got[0]) == (3, 3, [0, 1, 2], [1.0, 2.0, 3.0]) and tuple(got[1]) == (4, 3, [0, 2], [4.0, 6.0])
    assert tuple(got[2]) == (5, 3, [], []) and got[3] is None


def test_files_roundtrip_and_strictness(spark, tmp_path):
    df = spark.createDataFrame([(1, 4, [0, 3], [1.5, -2.0]), (2, 4, [], [])], vectors.SPARSE)
    for form in (1, 2):
        text.write_vectors(df, str(tmp_path / str(form)), form)
        assert sorted(map(tuple, text.read_vectors(spark, str(tmp_path / str(form))).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "bad.txt").write_text("(1,2,[1,0],[1.0,2.0])\n(2,2,[0],[3.0])\n")
    assert text.read_vectors(spark, str(tmp_path / "bad.txt"), strict=False).count() == 1
    with pytest.raises(Exception, match="not a vector line"):
        text.read_vectors(spark, str(tmp_path / "bad.txt")).collect()
    assert text.list_files(spark, str(tmp_path)).count() >= 3


def test_sparse_dots(spark):
    cases = [([0, 2, 3, 9], [2, 3], 2.0), ([0, 2, 3, 9], [5, 6], 0.0), ([0, 2, 3, 9], [3, 6, 9], 2.0)]
    rows = [(a, [1.0] * len(a), b, [1.0] * len(b), w) for a, b, w in cases]
    df = spark.createDataFrame(rows, "ia array<int>, va array<double>, ib array<int>, vb array<double>, w double")
    got = df.select(similarity.sparse_dot(F.col("ia"), F.col("va"), F.col("ib"), F.col("vb")).alias("d"), "w").collect()
    assert all(r.d == r.w for r in got)


def test_factories():
    assert vectors.make_vector(1, [(2, 5.0), (0, 1.0)], size=3) == (1, 3, [0, 2], [1.0, 5.0])
    assert vectors.make_vector(1, np.array([0.0, 2.0])) == (1, 2, [1], [2.0])
    for wrong in ([(0, 1.0), (0, 2.0)], [(7, 1.0)]):
        with pytest.raises(ValueError):
            vectors.make_vector(1, wrong, size=3)
    row = (7, 9, [1, 8], [0.5, -1.0])
    assert vectors.from_bytes(vectors.to_bytes(*row)) == row


def test_normalize_keeps_zero_vectors(spark):
    df = dense(spark, [(1, [3, 4]), (2, [0, 0])]).select("vector_id", vectors.normalize(F.col("values")).alias("v"))
    assert {r.vector_id: r.v for r in df.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_search_then_insert_sees_earlier_vectors_only(spark):
    v = dense(spark, [(k, [0.1, 0.2, 0.0]) for k in (1, 2, 3)])
    i = index.build_index(v, AngleFamily(scrambled_planes(2, 3, 3)))
    got = sorted((r.query_id, r.neighbor_id, round(r.similarity, 12)) for r in search.search_then_insert(v, i, 0.0).collect())
    assert got == [(2, 1, 0.05), (3, 1, 0.05), (3, 2, 0.05)]


@pytest.mark.parametrize("bucket_rows", [1, 3, 2000])
def test_candidates_do_not_depend_on_salts(spark, bucket_rows):
    rows = [(t, k % 3, k) for t in range(2) for k in range(12)]
    i = spark.createDataFrame(rows, "table_id int, bucket_key int, vector_id long")
    want = {(a, b) for a, b in itertools.permutations(range(12), 2) if a % 3 == b % 3}
    assert {tuple(r) for r in search.candidates(i, i, bucket_rows=bucket_rows).collect()} == want


def test_exact_knn_against_numpy(spark):
    x = np.random.default_rng(5).integers(-2, 3, (60, 4)).astype(float)
    v = dense(spark, list(enumerate(x)))
    got = {(r.query_id, r["rank"]): r.neighbor_id for r in search.exact_knn(v.filter("vector_id < 9"), v, 5, pass_bytes=64).collect()}
    s = x @ x.T
    for q in range(9):
        order = sorted((j for j in range(60) if j != q), key=lambda j: (-s[q, j], j))[:5]
        assert [got[q, r + 1] for r in range(5)] == order


def test_recall_grows_with_tables_and_candidates_are_pairs(spark):
    x = np.random.default_rng(6).normal(size=(80, 8))
    v = dense(spark, list(enumerate(x)))
    exact = search.exact_knn(v, v, 5)
    seen = []
    for tables in (1, 4, 8):
        i = index.build_index(v, AngleFamily(scrambled_planes(tables, 4, 8)))
        found = search.top_k(search.verify(search.candidates(i, i), v), 5)
        seen.append(evaluate.recall(found, exact).agg(F.avg("recall")).first()[0])
    assert seen[0] <= seen[1] <= seen[2] <= 1


def test_slots_are_dense(spark):
    v = dense(spark, list(enumerate(np.random.default_rng(7).normal(size=(50, 6)))))
    slots = index.vector_slots(index.build_index(v, AngleFamily(scrambled_planes(3, 3, 6)))).collect()
    for t in range(3):
        mine = sorted((r.slot, r.bucket_key) for r in slots if r.table_id == t)
        assert [s for s, _ in mine] == list(range(50)) and [b for _, b in mine] == sorted(b for _, b in mine)


class Trie:
    """A plain trie that takes keys one by one; for comparison."""

    def __init__(self, overflow):
        self.overflow, self.leaves, self.split = overflow, {}, set()

    def add(self, who, p):
        d = 1
        while p[d - 1] in self.split:
            d += 1
        leaf = self.leaves.setdefault(p[d - 1], [d, []])
        if len(leaf[1]) >= self.overflow and d < len(p):
            del self.leaves[p[d - 1]]
            self.split.add(p[d - 1])
            for w, q in [*leaf[1], (who, p)]:
                self.leaves.setdefault(q[d], [d + 1, []])[1].append((w, q))
        else:
            leaf[1].append((who, p))


def replay(paths, overflow):
    """The final depth of each path when they arrive one by one."""
    leaves, split, depth = {}, set(), [1] * len(paths)
    for k, p in enumerate(paths):
        d = 1
        while p[d - 1] in split:
            d += 1
        made, entries = leaves.setdefault(p[d - 1], (0, []))
        entries.append(k)
        depth[k] = d
        if len(entries) > max(overflow, made) and d < len(p):
            split.add(p[d - 1])
            del leaves[p[d - 1]]
            below = {}
            for e in entries:
                below.setdefault(paths[e][d], []).append(e)
                depth[e] = d + 1
            leaves |= {name: (len(found), found) for name, found in below.items()}
    return depth


def test_five_equal_hashes_end_one_level_down():
    paths = [("a", "aa", "aaa", "aaaa")] * 5
    assert replay(paths, 4) == [2] * 5
    assert replay(paths + paths[:1], 4) == [3] * 6


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=40), st.integers(1, 5))
def test_replay_follows_a_trie(keys, overflow):
    paths = [tuple(f"{k >> s}/{s}" for s in (4, 2, 0)) for k in keys]
    trie = Trie(overflow)
    for who, p in enumerate(paths):
        trie.add(who, p)
    want = {w: d for d, entries in trie.leaves.values() for w, _ in entries}
    assert replay(paths, overflow) == [want[k] for k in range(len(keys))]


def test_adaptive_modes(spark):
    rnd = random.Random(4)
    rows = [(0, rnd.choice([5, 9, -7, 2**30]) + rnd.randrange(3), k) for k in range(60)]
    i = spark.createDataFrame(rows, "table_id int, bucket_key int, vector_id long")
    g = adaptive.Geometry(28, 128, 32, 4)
    counted = {r.vector_id: (r.leaf, r.depth) for r in adaptive.assign_leaves(i, g).collect()}
    assert len(counted) == 60
    by_depth = {}
    for r in i.withColumn("p", F.array(*adaptive.path(F.col("bucket_key"), g))).collect():
        for d, p in enumerate(r.p):
            by_depth.setdefault((d, p), []).append(r.vector_id)
    for (d, p), who in by_depth.items():
        for w in who:
            if len(who) > g.overflow and d + 1 < g.top_level + 1:
                assert counted[w][1] > d + 1
    ordered = {r.vector_id: r.depth for r in adaptive.assign_leaves(i, g, "order_exact").collect()}
    paths = [tuple(r.p) for r in i.withColumn("p", F.array(*adaptive.path(F.col("bucket_key"), g))).orderBy("vector_id").collect()]
    assert [ordered[k] for k in range(60)] == replay(paths, 4)
    with pytest.raises(ValueError):
        adaptive.assign_leaves(i, g, "no such mode")


def test_sparse_join_against_brute_force(spark):
    rows = [(1, 9, [0, 2], [1.0, 2.0]), (2, 9, [2, 3], [3.0, 1.0]), (3, 9, [8], [1.0]), (4, 9, [], [])]
    got = [tuple(r) for r in search.sparse_join(spark.createDataFrame(rows, vectors.SPARSE), 1.0).collect()]
    assert got == [(1, 2, 6.0)]


@pytest.mark.parametrize("threshold", [-1.0, 0.5, 3.0, 8.0])
def test_sparse_joins_against_plain_sums(spark, threshold):
    rnd = random.Random(int(threshold))
    rows = []
    for k in range(60):
        at = sorted(rnd.sample(range(30), 8) if k % 3 else [0, 1, *rnd.sample(range(2, 30), 4)])
        rows.append((k, 30, at, [round(rnd.uniform(-1, 2), 2) for _ in at]))
    dense = {k: dict(zip(i, v, strict=True)) for k, _, i, v in rows}
    dot = lambda a, b: sum(x * dense[b].get(d, 0) for d, x in dense[a].items())
    share = lambda a, b: dense[a].keys() & dense[b].keys()
    df = spark.createDataFrame(rows, vectors.SPARSE)
    got = sorted((r.query_id, r.neighbor_id) for r in search.sparse_join(df, threshold).collect())
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60) if share(a, b) and dot(a, b) >= threshold]
    asked = sorted((r.query_id, r.neighbor_id) for r in search.sparse_join(df, threshold, queries="vector_id % 20 = 0").collect())
    assert asked == [(a, b) for a in range(0, 60, 20) for b in range(60) if a != b and share(a, b) and dot(a, b) >= threshold]


def test_hot_keys_are_dealt_by_salts(spark):
    rows = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(90)], "token string, vector_id long")
    table = rows.select("token").distinct().withColumn("n", F.length("token"))
    got = search.salted_join(rows, table, "token", part_rows=7)
    assert sorted(map(tuple, got.select("token", "vector_id", "n").collect())) == sorted((r.token, r.vector_id, len(r.token)) for r in rows.collect())


def test_percentiles_take_the_element_at_the_place(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 3, 9, 9, 9, 2, 7, 8]], "x double")
    got = {r.share: r.value for r in evaluate.percentile_summary(df, "x").collect()}
    values = sorted([5, 1, 1, 3, 9, 9, 9, 2, 7, 8])
    assert got == {s: float(values[int(10 * s)]) for s in (0.05, 0.25, 0.5, 0.75, 0.95)}


def test_numbering_and_synthetic(spark):
    df = spark.range(100).select((F.col("id") * 7 % 101).alias("x"))
    got = sorted((r.x, r.n) for r in text.number_rows(df, "x", "n").collect())
    assert [n for _, n in got] == list(range(100))
    assert text.synthetic(spark, 50, 10, 1.0).filter(F.size("indices") > 0).count() == 0
    assert text.load_capped(spark.createDataFrame([(9,), (4,), (7,)], "vector_id long"), 2).count() == 2


@pytest.mark.parametrize("chain", [1, 3, 12])
@pytest.mark.parametrize(("threshold", "k", "order"), [(None, 3, "similarity"), (0.0, 2, "id"), (0.4, None, "similarity"), (None, None, "similarity")])
def test_scored_blocks_against_pairs(spark, monkeypatch, chain, threshold, k, order):
    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "KEPT", 2)
    x = np.random.default_rng(chain).normal(size=(150, 8))
    x[60:75] = x[5]  # copies, of which the smaller ids come first
    ids = [*range(145), 3, 3, 4, 7, 7]  # ids that repeat have the buckets of all their rows
    v = dense(spark, list(zip(ids, x, strict=True)))
    i = index.build_index(v, AngleFamily(scrambled_planes(4, chain, 8))).filter("table_id > 0 OR vector_id % 3 > 0")
    asked = "vector_id % 2 = 0"
    queries, query_index = v.filter(asked), i.filter(asked)
    got = search.scored(v, i, threshold, k, order, queries=queries, query_index=query_index)
    want = search.verify(search.candidates(query_index, i), v, threshold, queries=queries)
    if k:
        got, want = search.top_k(got, k, order), search.top_k(want, k, order)
    columns = ["query_id", "neighbor_id"] if order == "id" else ["query_id", "neighbor_id", "similarity"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want)
    if not k:
        assert rows(search.scored(v, i, threshold, earlier_only=True)) == rows(search.verify(search.candidates(i, i, earlier_only=True), v, threshold))


def test_sparse_search_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "ENTRIES", 50)
    rnd = random.Random(3)
    rows = []
    for k in range(120):
        words = rnd.sample("abcdefghijklmnopqrstuvwxyz", rnd.choice([0, 1, 4, 20]))
        rows.append((k, words, [float(rnd.choice([1, 2, 30]) * rnd.choice([1, 1, -1])) for _ in words]))
    rows += [(None, ["a"], [900.0])]
    at = {k: dict(zip(i, v, strict=True)) for k, i, v in rows if k is not None}
    dot = lambda a, b: sum(x * at[b].get(d, 0) for d, x in at[a].items())
    df = spark.createDataFrame(rows, "vector_id long, indices array<string>, values array<double>")
    for threshold in (0.5, 400.0, 1e9):
        got = sorted(map(tuple, blocks.sparse_search(df, threshold, F.col("vector_id") % 20 == 0).collect()))
        assert got == [(a, b, dot(a, b)) for a in range(0, 120, 20) for b in range(120) if a != b and dot(a, b) >= threshold]
    assert blocks.sparse_search(df.limit(0), 1.0, F.col("vector_id") % 20 == 0).count() == 0
    with pytest.raises(ValueError):
        blocks.sparse_search(df, 0.0, F.lit(True))
