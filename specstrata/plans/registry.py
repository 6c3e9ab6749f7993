"""All queries of the core and their SQL."""

from __future__ import annotations

from specstrata.plans import pages, reference, training

MODULES = [training, pages, reference]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
