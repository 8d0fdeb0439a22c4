"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("q_text", "q_graph", "q_retrieval", "q_aggregate", "q_query", "q_more", "q_evidence", "q_stream", "q_batch", "q_validate", "q_gazetteer")


def _all() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"lodestar.plans.{name}").QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}


def entry(spark, sf_dir):
    """The flagship: hybrid retrieval, a ranked list by words fused with one by vectors."""
    return queries()["r10_hybrid_search"](spark, sf_dir)
