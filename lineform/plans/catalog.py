"""All registered queries of the library, and their oracle SQL."""

from __future__ import annotations

from lineform.plans import analytics, costs, evaluation, profile, wire

MODULES = (wire, profile, analytics, evaluation, costs)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
