"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module

from pitwarden.plans.registry import CATALOG, Query

MODULES = (
    "tables", "steps", "account", "bars", "labelling", "alerts", "detection",
    "effects", "facts", "mechanism", "overview", "rounds", "quality", "replays", "learning", "streams", "book",
)


def load_catalog() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"pitwarden.plans.{name}")
    return CATALOG
