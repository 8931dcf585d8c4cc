"""All queries over the given tables."""

from __future__ import annotations

from meshloom.plans import mesh, searches, shapes, stats, surfaces, terrain, texts

PARTS = (mesh, stats, surfaces, texts, terrain, searches, shapes)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
