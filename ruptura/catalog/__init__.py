"""Every operator as a query over the test tables, with an SQL check where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from ruptura.catalog.standins import ORACLES, QUERIES

MODULES = ["cleaning", "physics", "stats", "lmp", "selection", "ood", "modeling"]


def _load() -> None:
    for name in MODULES:
        import_module(f"ruptura.catalog.{name}")


def all_queries():
    _load()
    return QUERIES


def all_oracles():
    _load()
    return ORACLES
