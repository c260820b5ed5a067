"""All queries of the engine and the SQL each one must agree with."""

from __future__ import annotations

from . import curation_queries, evaluation_queries, grading_queries, io_queries, layout_queries, request_queries, rollout_queries, scoring_queries, token_queries  # noqa: F401  they register themselves
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
