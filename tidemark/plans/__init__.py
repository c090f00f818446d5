"""Registered queries."""

from tidemark.plans import (  # noqa: F401
    decision_queries, feature_queries, io_queries, metric_queries, model_queries, panel_queries, profile_queries, stream_queries,
)
from tidemark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
