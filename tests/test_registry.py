import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from simloom.plans import registry

TINY = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "knn_exact_topk", "lsh_topk_similarity", "lsh_candidates", "bucket_offsets", "vector_slots", "adaptive_leaf_buckets", "adaptive_candidates", "adaptive_leaves_in_order", "prefix_candidates",
    "inverted_index_candidates", "sparse_dot_join", "token_postings", "token_dot_join", "synthetic_sparse_vectors", "renumbered_load", "capped_load", "ann_recall_unindexed_queries", "kv_floor_ceiling", "kv_descending", "kv_composite_order",
    "kv_multi_get", "kv_secondary_key", "kv_secondary_keys_many", "kv_expire_after_access", "kv_expire_store_size", "kv_bulk_load_ignoring", "kv_transactions", "spilled_lookup", "sliding_windows",
    "session_windows", "percentile_summary", "bitset_flip", *(n for n, f in registry.QUERIES.items() if f.__module__.endswith("form_queries")),
])
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("embeddings", "documents", "nation", "orders", "lineitem", "part", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, TINY), con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(got.select(*names).collect()) == key(want.fetchall())


def test_descending_view_and_renumbered_load_have_all_rows(spark):
    orders = sorted((r.o_orderkey for r in spark.read.parquet(f"{TINY}/orders.parquet").collect()), reverse=True)
    got = {r.position: r.o_orderkey for r in registry.QUERIES["kv_descending"](spark, TINY).collect()}
    assert len(orders) > 100 and got == dict(enumerate(orders))
    vectors = spark.read.parquet(f"{TINY}/embeddings.parquet").orderBy("vec_id").collect()
    loaded = {r.vector_id: r.first_unit for r in registry.QUERIES["renumbered_load"](spark, TINY).collect()}
    assert sorted(loaded) == list(range(len(vectors)))
    assert all(abs(loaded[k] - r.embedding[0] / sum(x * x for x in r.embedding) ** 0.5) < 1e-5 for k, r in enumerate(vectors))


@pytest.mark.parametrize("cut,works", [("", True), ("llm", True), ("llm corpus_pipeline.py", True), ("broken", False)])
def test_only_a_missing_subpackage_is_passed_over(tmp_path, cut, works):
    root = Path(__file__).resolve().parent.parent
    if cut == "broken" and not (root / "simloom" / "llm").exists():
        pytest.skip("there is nothing to break")
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    if cut.startswith("llm"):
        shutil.rmtree(copy / "simloom" / "llm", ignore_errors=True)
    if cut.endswith(".py"):
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    if cut == "broken":
        (copy / "simloom" / "llm" / "words.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert (done.returncode == 0) == works, done.stderr
    if cut.startswith("llm"):
        assert int(done.stdout) == len(registry.QUERIES)
