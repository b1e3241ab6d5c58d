"""Registered queries over the shared test tables, each with the SQL that defines its result."""

from __future__ import annotations

from . import aggregation, condensation, corpus, graphs, retrieval, scoring

MODULES = (corpus, scoring, graphs, retrieval, condensation, aggregation)


def all_queries() -> dict:
    out = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def all_sql() -> dict:
    out = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
