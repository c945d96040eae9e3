"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from . import build, compare, graphs, times
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "build", "compare", "graphs", "times"]
