"""All registered queries and their SQL checks."""

from __future__ import annotations

from labelloom.plans import data_queries, evaluation_queries, job_queries, model_queries, session_queries, stream_queries
from labelloom.plans.registry import CHECKS, QUERIES

MODULES = (data_queries, evaluation_queries, session_queries, model_queries, job_queries, stream_queries)

__all__ = ["CHECKS", "MODULES", "QUERIES"]
