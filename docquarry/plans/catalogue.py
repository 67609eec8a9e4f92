"""Registered queries of the document analytics operators, with their DuckDB equivalents."""

from __future__ import annotations

from functools import wraps

from ..session import prepare
from . import answer_queries, chart_queries, data_queries, given_queries, source_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, answer_queries, data_queries, chart_queries, source_queries, given_queries)


def _prepared(query):
    @wraps(query)
    def run(spark, sf_dir):
        return query(prepare(spark), sf_dir)

    return run


def queries() -> dict:
    return {name: _prepared(q) for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
