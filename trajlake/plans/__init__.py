"""Registered queries and their SQL."""

from trajlake.plans import catalogs, draws, records, samples, scalars, statistics, texts, trajectories  # noqa: F401
from trajlake.plans.registry import ORACLES, QUERIES
from trajlake.plans.trajectories import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
