"""Names of the queries, with the DuckDB text that gives the same rows where there is one."""

from __future__ import annotations

from sealmark.plans import audit_queries, burst_queries, document_queries, evaluation_queries, face_queries, scalar_queries, score_queries, source_queries, store_queries, stream_queries, throttle_queries

MODULES = (store_queries, score_queries, burst_queries, throttle_queries, face_queries, audit_queries, scalar_queries, document_queries, evaluation_queries, source_queries, stream_queries)


def flagship(spark, sf_dir: str):
    """How many verification attempts passed, are pending or were rejected."""
    return store_queries.e3_decision_summary(spark, sf_dir)


def queries():
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql():
    return {name: text for m in MODULES for name, text in m.SQL.items()}
