"""Queries over the test tables, and the SQL that some of them must equal."""

from __future__ import annotations

from farspark.llm.registry import ORACLES, QUERIES
from farspark.llm import queries_chats, queries_copies, queries_scans, queries_text, queries_vectors  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
