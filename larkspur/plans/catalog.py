"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from . import q_clean, q_eval, q_features, q_invariants, q_models  # noqa: F401  (registration side effects)
from .registry import OPERATORS, ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}


def operators():
    return dict(OPERATORS)
