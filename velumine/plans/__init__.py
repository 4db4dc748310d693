"""Named queries over the driver's tables."""

from velumine.plans import graph, records, relational, search, state, texts, upkeep  # noqa: F401
from velumine.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
