"""Registered queries (Spark DataFrame plans) and their DuckDB oracles."""

from __future__ import annotations


def all_queries():
    from . import relational, models, features, parsing
    out = {}
    for m in (relational, models, features, parsing):
        out.update(m.QUERIES)
    return out


def all_oracles():
    from . import relational, models, features, parsing
    out = {}
    for m in (relational, models, features, parsing):
        out.update(m.ORACLE)
    return out
