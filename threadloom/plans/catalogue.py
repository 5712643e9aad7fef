"""All queries of the core and their SQL."""

from __future__ import annotations

from threadloom.plans import alignment, matching, nested, relational, retrieval, rules, sources, threads

MODULES = [retrieval, alignment, threads, relational, rules, sources, matching, nested]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
