import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from simloom.llm import lines, queries, topk

TINY = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def brute_top(rows, k, every):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, v in vecs:
        if i % every == 0:
            asking[i] = min(asking.get(i, v), v)
    out = {}
    for q, a in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vecs if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block_rows,part_rows,pass_queries", [(3, 20, 4), (128, 8192, 4096), (1, 7, 1)])
def test_top_k_against_brute_force(spark, block_rows, part_rows, pass_queries):
    rng = np.random.default_rng(block_rows)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 8]) for i in rng.permutation(90)]
    rows += [(5, rows[0][1]), (10, rows[1][1]), (200, None), (205, [1.0, None, 0.0, 0.0, 0.0]), (210, [math.nan] * 5), (215, [math.inf] * 5), (None, [1.0] * 5), (220, [0.5, 0.5]), (225, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = {}
    for r in topk.top_k(df, 6, 5, block_rows=block_rows, part_rows=part_rows, pass_queries=pass_queries).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert {q: [found[k] for k in sorted(found)] for q, found in got.items()} == brute_top(rows, 6, 5)
    assert topk.top_k(df.limit(0), 6, 5).count() == 0


def test_bounds_prune_blocks():
    near, far = np.array([[900, 900]] * 4), np.array([[-900, -900]] * 4)
    blocks = [topk.Block(np.arange(4) + 10 * b, near if b == 3 else far) for b in range(8)]
    scores, ids, scored = topk.search_blocks(np.array([[1, 1]]), np.array([999]), blocks, 2)
    assert scored == 1 and ids.tolist() == [[30, 31]] and scores.tolist() == [[1800, 1800]]


def test_shared_floors_prune_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k // 50] + 0.05 * rng.normal(size=8)).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, topk.top_k(df, 5, 20, block_rows=8, part_rows=60).collect()))
    monkeypatch.setattr(topk, "SEED_ROWS", 60)
    assert sorted(map(tuple, topk.top_k(df, 5, 20, block_rows=8, part_rows=60).collect())) == want
    q = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64)
    blocks = [topk.Block(np.arange(a, a + 10), q[a : a + 10]) for a in range(0, 300, 10)]
    asking = np.arange(0, 300, 20)
    scores, ids, scored = topk.search_blocks(q[asking], asking, blocks, 5)
    again = topk.search_blocks(q[asking], asking, blocks, 5, scores[:, 4])
    assert (again[0] == scores).all() and (again[1] == ids).all() and again[2] <= scored < 0.5 * len(asking) * len(blocks)


def test_rows_that_repeat_an_id_match_the_sql(spark, tmp_path):
    rows = [(100, [0.5, 0.1]), (100, [0.25, 0.7]), (100, [0.25, 0.7]), (1, [0.3, 0.3]), (1, [0.3, 0.3]), (200, [0.0, 0.0]), (7, None), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(con.execute(topk.TOP_K_SQL).fetchall())


def test_huge_components_are_held_at_the_ends(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (1, [3e12, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(df, 3, 100).collect()}
    assert got[1] == 2**63 - 1 and got[2] < 0


def brute_lines(docs):
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                first[key(x)] = min(first.get(key(x), i), i)
    out = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if i is None or first.get(key(x), i) == i]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


LINE = st.sampled_from(["", " ", "short", "a line of text", "A LINE of text ", "\x0ba line of text", "Éé line of text", "éé line of text", "other line 123", "日本語日本語日本語日", "x" * 9, "x" * 10, "x" * 10 + "\r", "\x1cx" + "x" * 9])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.lists(LINE, max_size=5).map("\n".join))), max_size=8))
def test_lines_against_brute_force(spark, docs):
    df = spark.createDataFrame([(i, t, "k", None) for i, t in docs], "doc_id long, text string, key string, hash string")
    got = [tuple(r) for r in lines.dedup_lines(df).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(docs), key=str)


def test_long_documents_and_hot_lines(spark):
    docs = [(k, "\n".join([f"one hot line of all {k % 2 * 0}", *(f"line number {j} of text" for j in range(k * 50, k * 50 + 150))])) for k in range(20)]
    got = sorted(tuple(r) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute_lines(docs))


def test_hot_lines_fill_several_slices(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_ROWS", 5)
    monkeypatch.setattr(lines, "HOT_SHARE", 50)
    docs = [(k % 90, "\n".join(["one hot line of all", f"a line of {k % 45} documents", "short", "one hot line of all "])) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in lines.dedup_lines(df).collect()) == sorted(brute_lines(docs))


def test_lines_are_dealt_once(spark):
    rows = spark.createDataFrame([(bytes([k % 7]) * 16, k, k, 0) for k in range(50)], "hash binary, doc_id long, text_hash long, pos int")
    plan = lines.first_documents(rows)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("rangepartitioning")]
    assert above.count("Window") == 1 and "hashpartitioning" not in above.split("BroadcastExchange")[0] and above.split("Window")[1].count("Sort ") == 1


def test_bitmaps_name_the_lines_that_stay(spark):
    docs = [(1, "\n".join(f"line number {k} of it" for k in range(130))), (2, "\n".join(f"line number {k} of it" if k in (0, 70, 129) else f"another line {k}" for k in range(130))), (3, "alone in the table")]
    rows = lines.keep_bitmaps(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_dropped) for r in rows] == [(2, 3)]
    dropped = {64 * w + p for w, bits in rows[0].keeps.items() for p in range(64) if not bits >> p & 1}
    assert dropped == {0, 70, 129}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, TINY), con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.fetchall()))


def test_kept_digest(spark):
    r = queries.op3_line_dedup(spark, TINY).join(spark.read.parquet(f"{TINY}/documents.parquet"), "doc_id").filter(F.col("n_dropped") == 0).first()
    assert r.kept_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
