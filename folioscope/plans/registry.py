"""All registered queries and their SQL checks."""

from __future__ import annotations

from folioscope.plans import q_corpus, q_questions, q_retrieval, q_sources, q_streaming, q_usage

MODULES = [q_corpus, q_questions, q_retrieval, q_usage, q_sources, q_streaming]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
