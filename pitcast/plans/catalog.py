"""All registered queries."""

from __future__ import annotations

from pitcast.plans import queries_asof, queries_checks, queries_features, queries_hourly, queries_models, queries_rollups, queries_sources  # noqa: F401
from pitcast.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
