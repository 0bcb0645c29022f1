"""Registered queries of the timeline engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from cuebeam.plans import library_queries, plan_queries, text_queries, timeline_queries

_MODULES = (text_queries, timeline_queries, plan_queries, library_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
