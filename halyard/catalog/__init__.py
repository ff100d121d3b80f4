"""Registered queries: every operator bound to the star tables."""

from halyard.catalog.registry import ORACLES, QUERIES


def load_all() -> None:
    """Import the modules that register queries (once)."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"halyard.catalog.{name}")


MODULES = ["aggregations", "cleaning", "relational", "windows", "metrics", "features", "rules", "models", "judged"]

__all__ = ["ORACLES", "QUERIES", "load_all"]
