"""Queries over the test tables, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from lexdrift.plans import evaluation, models, streams, text, threads, vectors, vocabulary

MODULES = [text, threads, vocabulary, vectors, evaluation, models, streams]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
