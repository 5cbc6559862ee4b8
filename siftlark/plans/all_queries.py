"""All queries of the engine: importing the modules registers them."""

from __future__ import annotations

from siftlark.plans import evaluation_queries, run_queries, source_queries, stream_queries  # noqa: F401
from siftlark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
