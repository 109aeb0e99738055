"""All queries of the core with their SQL."""

from __future__ import annotations

from annalist.plans import core_problems, fold_queries, graph_queries, search_queries, source_queries, timeline_queries, tool_queries

_MODULES = (core_problems, search_queries, fold_queries, graph_queries, source_queries, timeline_queries, tool_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in getattr(m, "SQL", {}).items()}
