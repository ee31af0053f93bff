"""Importing this module registers every query."""

from engramlake.plans import (  # noqa: F401
    conversations_rewards,
    entities_changes,
    event_streams,
    grading_scoring,
    memory,
    questions,
    sources_domains,
    streams,
)
from engramlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
