"""Every registered query."""

from suite import queries_far, queries_model, queries_series, queries_time  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
