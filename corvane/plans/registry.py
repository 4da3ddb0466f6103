"""All queries of the library proper, with their SQL."""

from __future__ import annotations

from corvane.plans import corpus, evaluation, more, notes, ranking, retrieval, streams

MODULES = (retrieval, evaluation, corpus, more, notes, ranking, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
