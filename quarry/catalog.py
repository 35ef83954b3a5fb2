"""All registered queries but those of the removable subpackage."""

from __future__ import annotations

from quarry.queries import aggregates, apportion, identity, joins, kernels, metrics, ranking, runs, selection, state, streams  # noqa: F401
from quarry.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
