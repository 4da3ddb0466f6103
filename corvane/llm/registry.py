"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corvane.llm import ann, bpe, jaccard, langid, mixing, negatives, quality, secrets, sharding, spelling, toxicity, urlfilter, vectordedup
from corvane.llm.common import importable

MODULES = (sharding, mixing, urlfilter, ann, secrets, langid, toxicity, jaccard, bpe, quality, spelling, negatives, vectordedup)


def _ready(query):  # noqa: ANN001, ANN202
    def run(spark, sf_dir: str):  # noqa: ANN001, ANN202
        importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _ready(f) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
