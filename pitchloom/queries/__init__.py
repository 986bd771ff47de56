"""The operators as queries over the driver's tables, each with its oracle SQL."""

from . import contours, excerpts, gates, learning, live, lookups, stored  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
