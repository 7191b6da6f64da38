"""Registered queries: each key has a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["graph", "functions", "plans", "knowledge", "views", "extraction", "streams", "changes"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]
