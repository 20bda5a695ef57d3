"""The query catalogue: one query for each operator, with the same result in SQL."""

from __future__ import annotations

from sluice.plans import cases_queries, helper_queries, io_queries, ordered_queries, relational_queries, text_queries
from sluice.plans.registry import ORACLES, QUERIES

#: Importing the modules registers their queries.
MODULES = (cases_queries, ordered_queries, relational_queries, text_queries, io_queries, helper_queries)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
