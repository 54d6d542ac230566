"""All queries outside the training-data folder."""

from __future__ import annotations

from . import behaviour_queries, image_queries, job_queries, sample_queries, scoring_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
