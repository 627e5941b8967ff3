"""Registry of every implemented query/operator and its DuckDB oracle SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "clean_queries",
    "report_queries",
    "eval_queries",
    "store_queries",
    "ml_queries",
    "explain_queries",
    "stream_queries",
]


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = import_module(f"{__package__}.{m}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
