"""The operators at work on the driver tables: one Spark query per operator, most with the same result in SQL."""

from __future__ import annotations

from foliant.queries import edits, lexical, records, search, storage

MODULES = (search, records, edits, lexical, storage)


def all_queries() -> dict:
    return {name: pair[0] for module in MODULES for name, pair in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: pair[1] for module in MODULES for name, pair in module.QUERIES.items() if pair[1]}
