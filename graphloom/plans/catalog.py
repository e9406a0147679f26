"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from graphloom.plans import data_quality, retrieval_queries

_MODULES = [data_quality, retrieval_queries]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
