"""All queries and their SQL."""

from rolloom.plans import answer_queries, array_queries, more_queries, rollout_queries, run_queries, text_queries, turn_queries  # noqa: F401
from rolloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
