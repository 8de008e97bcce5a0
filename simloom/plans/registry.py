"""Named queries over the test tables and their SQL twins."""

from __future__ import annotations

from simloom.plans import form_queries, kv_queries, vector_queries

QUERIES, ORACLES = vector_queries.QUERIES, vector_queries.ORACLES
assert kv_queries and form_queries  # their queries are registered on import


def flagship(spark, sf_dir):
    """Bucket candidates, exact verification and the ten most similar of each vector."""
    return QUERIES["lsh_topk_similarity"](spark, sf_dir)
