"""All registered queries and their SQL."""

from __future__ import annotations

from . import audit_queries, mesh_queries, profile_queries, ray_queries, render_queries, store_queries, volume_queries

_PARTS = (ray_queries, profile_queries, mesh_queries, volume_queries, render_queries, store_queries, audit_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
