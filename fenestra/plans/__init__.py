"""Queries by name on the driver's tables."""

from __future__ import annotations

from fenestra.plans import curate, joins, library, manifests, placements, rankings, replies, reports, search, selections, tasks  # noqa: F401  each adds its queries

QUERIES = {name: f for name, (f, _) in reports.Q.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in reports.Q.items() if sql is not None}
