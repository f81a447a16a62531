"""Driver-table unit panel, registered queries with SQL oracles, pipeline."""

from __future__ import annotations


def load_all() -> None:
    """Import every query module so the registry is complete."""
    import importlib

    for m in ("q_scoring", "q_relational", "q_models", "q_sources"):
        importlib.import_module(f"placescore.plans.{m}")
