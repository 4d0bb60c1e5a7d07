"""All registered queries and their SQL."""

from __future__ import annotations

from marketlens.plans import listing_queries, name_queries, outcome_queries, page_queries, review_queries, run_queries, session_queries, visit_queries  # noqa: F401  they register their queries
from marketlens.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
