"""Queries on the driver's tables with their DuckDB twins."""

from importlib import import_module
from pathlib import Path


def all_queries():
    """Import every query module and return the filled registries."""
    for path in sorted(Path(__file__).parent.glob("*_queries.py")):
        import_module(f"checks.{path.stem}")
    registry = import_module("checks.registry")
    return dict(registry.QUERIES), dict(registry.ORACLE)
