import contextlib
import io

import pytest

from simloom.operators import search
from simloom.plans import registry

TINY = "/root/testdata/sf0.001"
EAGER = ("stream_", "renumbered_", "token_", "kv_transactions", "spilled_", "vector_files_", "index_written_", "kv_snapshot", "kv_catalog_", "kv_sizes")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ranges_and_columns_reach_the_scan(spark):
    text = plan(registry.QUERIES["kv_range_scan"](spark, TINY))
    assert "GreaterThanOrEqual(o_orderkey,100)" in text and "LessThan(o_orderkey,5000)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith(EAGER)))
def test_no_cross_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, TINY))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["kv_upsert_latest", "kv_sort_merge_dedup", "bitset_or", "kv_floor_ceiling", "adaptive_leaf_buckets"])
def test_grouping_combines_before_the_shuffle(spark, name):
    assert "partial_" in plan(registry.QUERIES[name](spark, TINY)).replace("functions=[]", "")


@pytest.mark.parametrize("name", ["kv_floor_ceiling", "bucket_offsets", "vector_slots", "kv_descending", "adaptive_candidates", "prefix_candidates", "kv_secondary_key"])
def test_no_rows_meet_in_one_task_or_array(spark, name):
    text = plan(registry.QUERIES[name](spark, TINY))
    assert "collect_list" not in text and "collect_set" not in text
    single = [k for k, line in enumerate(text.splitlines()) if "SinglePartition" in line or "SinglePartition" in line]
    assert len(single) <= (name == "kv_floor_ceiling") + 2 * (name == "kv_descending")  # one row a range, and no others


PAIRS_STAY = ["ann_mean_ratio", "ann_recall", "ann_ratio", "ann_recall_unindexed_queries", "lsh_topk_similarity", "lsh_topk_by_id", "lsh_search_then_insert", "stream_search_then_insert", "stream_compaction"]


@pytest.mark.parametrize("name", PAIRS_STAY)
def test_candidate_pairs_are_not_shuffled(spark, name, monkeypatch):
    def shuffled(*_, **__):
        raise AssertionError("candidate pairs are rows of a shuffle")

    monkeypatch.setattr(search, "candidates", shuffled)
    assert registry.QUERIES[name](spark, TINY).count() > 0


def test_products_of_tokens_are_not_joined(spark, monkeypatch):
    def joined(*_, **__):
        raise AssertionError("products of frequent tokens are rows of a join")

    monkeypatch.setattr(search, "sparse_join", joined)
    registry.QUERIES["token_dot_join"](spark, TINY).collect()
