"""Registered queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("report_queries", "ingest_queries", "matching_queries", "sql_queries")


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"cuadre.plans.{name}")
