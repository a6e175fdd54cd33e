"""Imports every plan module so that its queries register."""

from tillwatch.plans import decision_queries, feature_queries, matrix_queries, model_queries, quality_queries, rolling_queries, storage_queries, stream_queries  # noqa: F401
from tillwatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
