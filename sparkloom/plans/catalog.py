"""Every registered query with its SQL twin."""

from __future__ import annotations

from sparkloom.plans import graph, incremental, pairs, scalars, sources, stats, temporal, topk  # noqa: F401  they register queries
from sparkloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
