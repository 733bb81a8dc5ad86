"""Registered queries by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ("structure", "regulatory", "graph", "retrieval", "governance", "streaming")


def all_queries():
    from docgraph.plans.registry import QUERIES, SQL

    for name in SUBJECTS:
        import_module(f"docgraph.plans.{name}")
    return QUERIES, SQL
