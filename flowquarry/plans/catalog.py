"""All registered queries over the test tables."""

from __future__ import annotations

from flowquarry.plans import analytics_queries, application_queries, detection_queries, report_queries  # noqa: F401  they register themselves
from flowquarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
