"""All registered queries."""

from __future__ import annotations

from . import comment_plans, corpus_plans, funnel_plans, maintenance_plans, matrix_plans, retrieval_plans, source_plans, stream_plans  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
