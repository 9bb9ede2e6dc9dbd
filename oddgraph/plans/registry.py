"""All queries of the graph engine and their SQL twins."""

from __future__ import annotations

from oddgraph.plans.oracle import ORACLE
from oddgraph.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
