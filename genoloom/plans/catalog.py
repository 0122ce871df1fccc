"""All queries of the library, with their SQL."""

from __future__ import annotations

from genoloom.plans import annotation_queries, cluster_queries, question_queries, report_queries, text_queries  # noqa: F401
from genoloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "p6_collinear_histogram"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
