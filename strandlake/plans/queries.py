"""All queries of the engine over the driver's tables, and their SQL."""

from __future__ import annotations

from . import extra_queries, interval_queries, island_queries, pileup_queries, record_queries, repeat_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "agg26_majority_consensus"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
