"""Importing this module registers every query."""

from emberline.plans import book_queries, event_queries, insight_queries, metric_queries, model_queries, roundtrip_queries  # noqa: F401
from emberline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
