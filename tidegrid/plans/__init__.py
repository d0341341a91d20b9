"""Registered queries: every operator applied to the driver tables."""

from importlib import import_module

MODULES = ("sources", "projection", "series", "joins", "features", "stats", "merge", "ranking",
           "evaluation", "incremental", "quality", "models", "streaming")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidegrid.plans.{name}")
