"""Queries over the given tables."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "inputs", "search_queries", "catalog_queries", "alias_queries", "biblio_queries", "date_queries", "source_queries", "flagship",
]


def load_queries():
    for family in FAMILIES:
        import_module(f"bibliomill.plans.{family}")
    from bibliomill.plans.registry import QUERIES

    return QUERIES
