"""Named queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

import importlib

FAMILIES = (
    "matching",
    "verification",
    "regimes",
    "filters",
    "signals",
    "splitting",
    "statistics",
    "storage",
    "streams",
    "protocols",
)


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"probeline.plans.{family}")
