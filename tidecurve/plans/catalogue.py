"""Registry of the named queries over the driver tables and of their SQL."""

from __future__ import annotations

from tidecurve.plans import link_queries, meal_queries, retrieval_queries, signal_queries, stream_queries, text_queries, trial_queries

PARTS = (signal_queries, meal_queries, text_queries, link_queries, stream_queries, retrieval_queries, trial_queries)


def queries() -> dict:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQLS.items() if s}
